"""The queries of this subpackage, and SQL for those that SQL can express.

Each takes (spark, sf_dir), applies its operator to its whole table and returns the full result. They import their
operators as they run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    return apply_rules(table(spark, sf_dir, "documents"), with_text=False).select(*names)


ORACLE_SQL["op6_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, len(l) - len(list_distinct(l)) AS n FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)),
norm AS (SELECT doc_id, source, t, unnest(string_split(translate(lower(t), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), chr(10))) AS raw FROM d),
own AS (SELECT doc_id, source, t, trim(regexp_replace(raw, ' +', ' ', 'g'), ' ') AS line FROM norm WHERE trim(raw, ' ') <> ''),
counts AS (SELECT source, line, count(DISTINCT t) AS n FROM own GROUP BY source, line),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM own GROUP BY source),
above AS (SELECT counts.source, line FROM counts JOIN hosts ON counts.source IS NOT DISTINCT FROM hosts.source WHERE n > 20 AND n > 0.1 * docs),
lost AS (SELECT doc_id, sum(len(string_split(own.line, ' ')))::BIGINT AS n FROM own JOIN above ON own.source IS NOT DISTINCT FROM above.source AND own.line = above.line GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, lines.n::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words <= 0.5 * n_words AS kept, n_removed_words
FROM stats
"""


@query
def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse_snapshots, render_turns

    conversations = table(spark, sf_dir, "conversations")
    return render_turns(conversations, collapse_snapshots(conversations))


ORACLE_SQL["op10_chat_snapshots"] = """
WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
alike AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
kept AS (SELECT conv_id, len(l)::BIGINT AS n_turns FROM alike WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = alike.l))
SELECT conv_id, turn, n_turns, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM conversations JOIN kept USING (conv_id)
"""


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_words", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS lo FROM v GROUP BY h),
hit AS (SELECT doc_id, i FROM v JOIN first USING (h) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM hit, range(50) AS r(k) GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i)) END AS k FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query
def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


@query
def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


@query
def op4_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

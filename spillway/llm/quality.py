"""Quality rules: repetition within a text, and lines that recur across the documents of a host, in DataFrame functions alone.

Lines are normalised (lower case, digits as 0, white space as single spaces), hashed, and counted over the distinct
documents of their host. Exact copies of a text are one document, by a hash of the whole text, and a document counts once
for a line, however often and between whichever lines it has it. Lines in more documents of a host than `min_docs` and
than `max_share` of its documents (its distinct texts with a line) are removed; a document that loses more than `max_lost`
of its words is rejected.

Texts are read and normalised once: statistics and hashed lines go to a table in the shared folder, from which all else
follows. Only hashes are shuffled, never texts (but where cleaned texts are asked for). Copies combine before the shuffle,
each with the hashes of its lines in one row, and so do the counts, so a line in every document costs one row per task;
the join of line positions with the lines to remove is an equi-join that Spark can split where a key is hot. Hosts are
joined by name with their limits, which are as few as the hosts.

Defined cases: null text is empty; a null host is a host of its own; documents with the same doc_id, host and text get
the same verdict; the null doc_id is an id like others; extra columns are kept, but for those named like a result; empty
in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import GAP_CLASS, SPACE, let, materialise, text_of

MIN_WORDS, MAX_REPEATED = 20, 30
#: Defaults of the method: documents of a host, their share, and the share of its words that a document may lose.
MIN_DOCS, MAX_SHARE, MAX_LOST = 20, 0.1, 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes[i] is of the window that starts at word i."""

    def count(sorted_pairs: Column) -> Column:
        same = lambda i, j: F.get(sorted_pairs, i)["h"].eqNullSafe(F.get(sorted_pairs, j)["h"])
        repeated = F.filter(sorted_pairs, lambda p, i: same(i, i - 1) | same(i, i + 1))
        starts = F.array_sort(F.transform(repeated, lambda p: p["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, count))


def text_stats(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""

    def of(words: Column) -> Column:
        n = F.size(words)
        windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        repeats = F.when(n > WINDOW, let(windows, _covered)).otherwise(F.lit(0))
        return F.struct(n.cast("bigint").alias("n_words"), repeats.cast("bigint").alias("n_repeat_words"))

    words = F.filter(F.split(text, f"{GAP_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    inner = let(words, of)
    return F.struct(
        inner["n_words"].alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"),
        inner["n_repeat_words"].alias("n_repeat_words"),
    )


def normalised_lines(text: Column) -> Column:
    """The lines of a text with a word, as they are compared."""
    plain = F.translate(F.lower(text), "123456789\t\x0b\x0c\r", "000000000    ")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return lines


def _key(host: str) -> Column:
    """doc_id, host and a hash of the text: what tells documents apart here."""
    return F.struct(F.col("doc_id").cast("string").alias("d"), F.col(host).cast("string").alias("h"), F.xxhash64(text_of(), F.lit(7)).alias("t"))


def _lines(text: Column) -> Column:
    """Number (from 0), hash and words of each line with a word."""
    each = F.transform(normalised_lines(text), lambda x, i: F.struct(i.alias("i"), F.when(x != "", F.xxhash64(x)).alias("h"), F.size(F.split(x, " ")).alias("w")))
    return F.filter(each, lambda x: x["h"].isNotNull())


def removed_lines(hashed: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """For each document that loses lines (key): their numbers, and how many words they have; from rows of key and lines."""
    # A row for each distinct text of a host: a line counts once there.
    texts = hashed.where(F.size("lines") > 0).select(F.col("key.h").alias("host"), F.col("key.t").alias("t"), F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("hs")).dropDuplicates(["host", "t"])
    counts = texts.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    limits = texts.groupBy("host").agg((F.count("*") * F.lit(max_share)).alias("most"))
    above = counts.join(limits, counts["host"].eqNullSafe(limits["host"])).where(F.col("n") > F.col("most")).select(counts["host"].alias("above_host"), F.col("h").alias("above_h"))
    # A line's count is at least min_docs, so a document has few such lines: only they go on from the join.
    placed = hashed.select("key", F.explode("lines").alias("x")).select("key", "x.i", "x.h", "x.w")
    found = placed.join(above, F.col("key.h").eqNullSafe(F.col("above_host")) & (placed["h"] == F.col("above_h")), "left_semi")
    each = found.groupBy("key", "i").agg(F.max("w").alias("w"))
    return each.groupBy("key").agg(F.collect_list("i").alias("numbers"), F.sum("w").cast("bigint").alias("n_removed_words"))


def apply_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_lost: float = MAX_LOST, with_text: bool = True) -> DataFrame:
    """docs with the statistics, n_removed_words, base_failed, kept and, with_text, clean_text (without the removed lines)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    carried = [c for c in docs.columns if c not in {*names, "n_removed_words", "base_failed", "kept", "clean_text"} and (with_text or c != "text")]
    numbered = {f"c{k}": F.col(c) for k, c in enumerate(carried)}  # apart from the operator's own columns
    own = {} if with_text else numbered
    first = docs.select(_key(host).alias("key"), text_stats(text_of()).alias("stats"), _lines(text_of()).alias("lines"), *[c.alias(n) for n, c in own.items()])
    hashed = materialise(first, "lines")
    lost = removed_lines(hashed, min_docs, max_share).withColumnRenamed("key", "lost_key")
    judged = hashed.join(lost, F.col("key").eqNullSafe(F.col("lost_key")), "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    judged = judged.select(*own, "key", *[F.col(f"stats.{n}").alias(n) for n in names], "n_removed_words", "numbers")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_removed_words") <= max_lost * F.col("n_words")))
    out = [F.col(n).alias(c) for n, c in zip(numbered, carried, strict=True)] + [F.col(n) for n in (*names, "n_removed_words", "base_failed", "kept")]
    if not with_text:
        return judged.select(*out)
    judged = judged.dropDuplicates(["key"])
    rows = docs.select(*[c.alias(n) for n, c in numbered.items()], F.col("text").alias("own_text"), _key(host).alias("own_key"))
    gone = F.col("numbers")
    clean = F.when(gone.isNull(), F.col("own_text")).otherwise(F.array_join(F.filter(F.split(F.col("own_text"), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return rows.join(judged, F.col("own_key").eqNullSafe(F.col("key"))).withColumn("own_clean", clean).select(*out, F.col("own_clean").alias("clean_text"))

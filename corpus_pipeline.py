"""From raw documents to packed training sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases, for each stage and for all together: a null text is empty and goes with the quality rules, as texts of under
20 words do; a null doc_id is an id like others, but comes last where the smallest id stays; rows that repeat (doc_id and
text) are one document for the near-duplicate stage, and rows that share a doc_id but not the text are told apart by the
text; a null source is a source of its own; extra columns are kept up to the last stage, whatever their names; an empty
table gives an empty result of the same columns.

The tables that a stage writes on its way are deleted when the next stage of the same input begins, as the stage's result
is stored by then, or when run() is through with them. Tables of other calls are never touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm._util import delete, materialise, noted, table, text_of
from spillway.llm.ngram_join import grouped_rows
from spillway.llm.packing import pack
from spillway.llm.pii import mask
from spillway.llm.quality import apply_rules
from spillway.llm.substring import remove_repeats

#: Rows that are broadcast at most.
BROADCAST_ROWS = 200_000


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: By application and input: tables that the stage before wrote on its way.
_HELD: dict[tuple[str, str], list] = {}


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        delete(_HELD.pop(key, []))
        names = docs.columns
        apart = [c if c in _COLUMNS else f"_extra_{k}" for k, c in enumerate(names)]  # from the operators' own columns
        with noted() as tables:
            out = f(spark, docs.toDF(*apart), sf_dir)
        _HELD[key] = tables
        return out.toDF(*names) if out.columns == apart else out

    return run


def _renewed(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """changed with the columns of docs, where `text` is the text and n_chars fits it."""
    own = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return changed.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines that recur across their host."""
    return _renewed(docs, apply_rules(docs).where("kept"), "clean_text")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, and of each repeated row, one stays: the one of smallest doc_id, null being
    greatest, and of rows that share it the one of smallest text hash. Rows are told apart by doc_id and text hash."""
    found = materialise(grouped_rows(docs), "components")
    row = ["doc_id", "text_hash"]
    linked = found.where(F.col("component").isNotNull())
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Different texts can share the smallest doc_id, or its lack.
    ties = linked.where(first).groupBy("component").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where(F.col("lo") != F.col("hi"))
    behind = linked.where(first).join(ties, "component").where(F.col("text_hash") != F.col("lo"))
    gone = linked.where(~first).select(*row).union(behind.select(*row)).distinct().toDF("gone_id", "gone_hash")
    few = gone.count() <= BROADCAST_ROWS
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_of()) == F.col("gone_hash"))
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = found.groupBy(*row).count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents of smaller doc_id have too are cut; documents of which nothing is left go."""
    cut = remove_repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _renewed(docs, cut, "kept_text")


@_stage
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _renewed(docs, mask(docs), "text")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and their places in training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("PII", private_data),
    ("packing", packing),
]

#: SQL has no tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with noted() as tables:
            docs = materialise(found, name.replace(" ", "-"))
        delete(stored)
        stored = tables
    return STAGES[-1][1](spark, docs, sf_dir)

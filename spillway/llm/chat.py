"""Cumulative-snapshot collapse of logged conversations, in DataFrame functions alone.

A chat log often holds a conversation once per reply: every snapshot is a prefix of the next. A conversation is dropped if
its turns are the first turns of a longer one, or the same as those of one with a smaller conv_id; the others are
rendered.

Each turn has a 64-bit hash of its number, role and text; a prefix has the sum of its turns' hashes (three
times, with different seeds: 96 bits), so sums of whole conversations need no order and combine before the shuffle. Rolling sums
come from two windows, over chunks of a conversation and within a chunk, so that a conversation of any length is spread
over many tasks. Prefixes that end before a conversation does are made distinct before the anti-join: a first turn that
every conversation shares is one row there.

Defined cases: turns are compared with their numbers; a null turn comes first, a null role or text differs from an empty
one; rows of one conversation with the same turn are one turn, whose rows are compared as a multiset; rows with null
conv_id are one conversation, which comes after all others in ties; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a chunk.
CHUNK = 256
#: Sums of hashes wrap within this many bits, so that they never overflow a long.
_BITS = (1 << 32) - 1
_SUMS = ("a", "b", "c")


def _turn_hashes() -> list[Column]:
    """Three 32-bit hashes of a turn; sums of 2**31 of them fit a long, and rolling sums are cut to 32 bits again."""
    fields = [F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    seeds = [F.lit("first"), F.lit("second"), F.lit("third")]
    return [F.xxhash64(s, *fields).bitwiseAND(F.lit(_BITS)).alias(n) for s, n in zip(seeds, _SUMS, strict=True)]


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns (rows) of the conversations that remain."""
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.select("conv_id", "turn", *_turn_hashes())
    cut = lambda c: c.bitwiseAND(F.lit(_BITS))
    # A turn's rows count together: a prefix ends after all of them.
    each = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *[cut(F.sum(cut(F.col(s)))).alias(s) for s in _SUMS])
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    each = each.withColumn("chunk", chunk)
    sums = ["n", *_SUMS]
    chunks = each.groupBy("conv_id", "chunk").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums], *[F.sum(s).over(whole).alias(f"{s}_whole") for s in sums])
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    rolled = each.select("conv_id", "chunk", *[F.sum(s).over(within).alias(s) for s in sums])
    on = rolled["conv_id"].eqNullSafe(chunks["conv_id"]) & (rolled["chunk"] == chunks["chunk"])
    wrap = lambda s, c: c if s == "n" else cut(c)
    both = rolled.join(chunks, on)
    prefixes = both.where(rolled["n"] + F.col("n_before") < F.col("n_whole")).select(*[wrap(s, rolled[s] + F.col(f"{s}_before")).alias(s) for s in sums]).distinct()
    conversation = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *[cut(F.sum(F.col(s))).alias(s) for s in _SUMS])
    alike = conversation.groupBy(*sums).agg(F.min("conv_id").alias("conv_id"))
    return alike.join(prefixes, sums, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render_turns(conversations: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The turns of the conversations in `kept`, each as it stands in the training text; in order of turn they are the text.

    A row per turn, so that no conversation has to fit in one task. A null role or text is rendered as empty.
    """
    kept = kept.select(F.col("conv_id").alias("kept_id"), "n_turns")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rendered = F.concat(F.lit(start), role, F.lit("\n"), text, F.lit(end + "\n"))
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), rendered.alias("rendered"))
    return turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "turn", "n_turns", "rendered")


def render(turns: DataFrame) -> DataFrame:
    """One text per conversation, for conversations that fit in a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "rendered"))), lambda x: x["rendered"])
    return turns.groupBy("conv_id", "n_turns").agg(F.array_join(parts, "").alias("text"))

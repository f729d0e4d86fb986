"""Mixing sources to target weights by repetition rates.

Tokens (here words) are summed per source, every source gets a share of the total by its weight, and a
document of a source with rate ``r = target / size`` is emitted ``floor(r)`` times plus one more time with
probability ``r - floor(r)``, decided by a hash of its id and the seed, so that reruns agree.

Plan: one pass that sums per source (with partial sums in each task, so a hot source costs nothing), a small
table with a row per source, and a second pass that joins each document with its source's rate. That table
is broadcast only while its measured row count is under ``BROADCAST_SOURCES``; beyond it Spark joins by shuffle, where
adaptive execution splits a hot source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import hidden, offsets_by_partition, stage

#: Weights by the order of sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_RATE = 3
#: Up to so many sources (names of at most a few hundred bytes) are broadcast.
BROADCAST_SOURCES = 20_000
#: From so many sources on, they are put in order by range partitions rather than in one task.
ONE_TASK_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    squeezed = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), r"[\x20\x09-\x0D]++", "")
    return F.coalesce(F.length(squeezed), F.lit(0)).cast("long")


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``pos``: the place of each source by code point, null last. Few sources are numbered by one
    window; many are range-partitioned, numbered within each partition and shifted by the partitions before."""
    if sizes.count() <= ONE_TASK_SOURCES:
        order = Window.orderBy(F.col("source").asc_nulls_last())
        return sizes.withColumn("pos", F.row_number().over(order).cast("long") - 1)
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id())
    dealt = stage(dealt, "mix-sources")
    shifts = offsets_by_partition(dealt.withColumn("one", F.lit(1)), "pid", "one")
    shift = F.broadcast(dealt.sparkSession.createDataFrame(shifts, "pid int, before long"))  # a row per partition
    order = Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("place", F.row_number().over(order).cast("long") - 1)
        .join(shift, "pid")
        .select("source", "source_size", (F.col("place") + F.col("before")).alias("pos"))
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Targets share the total size by weight; a target above ``max_rate`` times its source's size stops there and
    the excess is shared again by weight among the others, until none is above. Each round needs two sums over
    the sources; a round that stops no further source is the last one.
    """
    known = ordered_sources(sizes).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("pos") % len(weights) + 1).cast("int"))
    )
    known = stage(known.select("source", "source_size", "weight"), "mix-weights")
    cap = F.col("source_size") * float(max_rate)
    total = known.agg(F.sum("source_size")).first()[0] or 0
    # A source stops when level * weight > cap, and the level only rises: stopped sources stay stopped.
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = known.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, True)).alias("n"),
        ).first()
        if row.n == stopped or not row.open:
            break
        stopped, level = row.n, (total - row.used) / row.open
    return known.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


#: What ``mix`` adds, and the names that its columns have if no others are given.
ADDED = {"size": "_size", "source_size": "_source_size", "target": "_target", "copies": "_copies"}


def draw(doc_id: Column, seed: int) -> Column:
    """A fixed number from 0 up to 1: 52 bits of the md5 of seed and id; a null id is the word null."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_rate: int = MAX_RATE,
    seed: int = 17,
    size: Column | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source, ...) with the size of each, that of its source, the source's target and the number of copies, under ``names`` (else ``ADDED``).

    A null text has size 0; a null source is a source of its own, last in the order; rows that repeat a doc_id
    share one decision; a null doc_id is hashed as such. A source of size 0 has target 0 and copies 0. Very long texts are counted whole.
    An empty table gives an empty table. Further columns stay as they are; those that have one of the four names are replaced.
    """
    names = ADDED | (names or {})
    taken = {n.lower() for n in names.values()}
    own = word_count(F.col("text")) if size is None else size
    counted = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken], own.alias(names["size"]))
    sums = counted.groupBy("source").agg(F.sum(names["size"]).alias("source_size"))
    key = hidden(counted, "source")
    goals = targets(stage(sums, "mix-sizes"), weights, max_rate).select(
        F.col("source").alias(key), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"])
    )
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    joined = counted.join(goals, counted["source"].eqNullSafe(goals[key]), "left").drop(key)
    total, goal = F.col(names["source_size"]), F.col(names["target"])
    rate = F.when(total > 0, goal / total).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(names["copies"], F.least(copies, F.lit(max_rate)).cast("int"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it was taken, in the columns of ``docs``."""
    names = {k: hidden(docs, f"mix_{k}") for k in ADDED}
    mixed, copy = mix(docs, names=names, **options), hidden(docs, "mix_copy")
    rows = mixed.where(F.col(names["copies"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

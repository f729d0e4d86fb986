"""Streams: windows with watermarks, and a versioned table that micro-batches keep current."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("first_ts"), "n")


def first_seen(rows: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class VersionedTable:
    """Rows (doc_id, hash, version, valid_from, valid_to, content) in one Parquet folder for each batch.

    A batch adds a version only for changed content; a withdrawal closes one. Batches are named by their number, so a batch that is
    run again replaces itself. ``history`` is the union of all batches' events; the current state is each document's last event."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def events(self, before: int | None = None) -> DataFrame | None:
        """Stored events (doc_id, hash, content, gone, batch) of earlier batches."""
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return rows if before is None else rows.where(F.col("batch") < before)

    def apply(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: rows (doc_id, content, gone). Of several rows of a document in a batch the greatest content counts."""
        new = batch.groupBy("doc_id").agg(F.max_by(F.struct("content", "gone"), F.struct(~F.col("gone"), "content")).alias("r"))
        new = new.select("doc_id", "r.content", "r.gone").withColumn("hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
        old = self.events(number)
        if old is not None:
            last = old.groupBy("doc_id").agg(F.max_by(F.struct("hash", "gone"), "batch").alias("l"))
            same = (F.col("l.hash") == F.col("hash")) & (F.col("l.gone") == F.col("gone"))
            new = new.join(last, "doc_id", "left").where(F.col("l").isNull() | ~same).select("doc_id", "content", "gone", "hash")
        new.write.mode("overwrite").parquet(os.path.join(self.path, f"batch={number}"))

    def history(self) -> DataFrame:
        """(doc_id, version, hash, content, gone, valid_from, valid_to) in numbers of batches."""
        from pyspark.sql import Window

        rows = self.events()
        order = Window.partitionBy("doc_id").orderBy("batch")
        return rows.select(
            "doc_id", F.row_number().over(order).alias("version"), "hash", "content", "gone", F.col("batch").alias("valid_from"), F.lead("batch").over(order).alias("valid_to")
        )

    def current(self) -> DataFrame:
        return self.history().where("valid_to IS NULL AND NOT gone").select("doc_id", "version", "content")

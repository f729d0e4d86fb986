"""TREC files: judgments and runs, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("trim(value) <> ''")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select(F.split(F.trim("value"), r"\s+").alias("f"), place.alias("place"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade); of a repeated pair the last line counts."""
    rows = _fields(spark, path).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("grade"), "place")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "place").alias("grade"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank): in the order of the rank column, then the id; the score is not read."""
    rows = _fields(spark, path).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order))


def read_judged_ids(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(F.col("f")[2].alias("doc_id")).distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(member, representative)."""
    return _fields(spark, path).select(F.col("f")[0].alias("member"), F.col("f")[1].alias("representative"))


def run_lines(run: DataFrame, setup: str) -> DataFrame:
    """(query_id, rank, line): the lines of a run file; a query without results has none."""
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), "rank", F.col("score").cast("double"), F.lit(setup))
    return run.select("query_id", "rank", line.alias("line"))


def write_run(run: DataFrame, setup: str, path: str) -> None:
    """A folder of run files in order; each query is in one file."""
    lines = run_lines(run, setup)
    lines.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").select("line").write.mode("overwrite").text(path)

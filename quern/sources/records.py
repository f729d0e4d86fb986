"""Harvested XML pages: records with a header and nested metadata elements, read in parallel with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = "ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>"
_LEVEL3 = f"ARRAY<STRUCT<_name: STRING, field: {_FIELD}>>"
_LEVEL2 = f"ARRAY<STRUCT<_name: STRING, field: {_FIELD}, element: {_LEVEL3}>>"
_LEVEL1 = f"ARRAY<STRUCT<_name: STRING, field: {_FIELD}, element: {_LEVEL2}>>"
SCHEMA = (
    "header STRUCT<_status: STRING, identifier: STRING, datestamp: STRING, setSpec: ARRAY<STRING>>, "
    f"metadata STRUCT<metadata: STRUCT<element: ARRAY<STRUCT<_name: STRING, field: {_FIELD}, element: {_LEVEL1}>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page, header, metadata) of every record of all pages, plain or gzip."""
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreSurroundingSpaces", "false").schema(SCHEMA).load(path)
    return rows.select(F.col("_metadata.file_name").alias("page"), "header", "metadata")


def fields(rows: DataFrame) -> DataFrame:
    """(identifier, name, value, lang): dotted names of the values of three levels; language "none" is null."""
    top = rows.select(F.trim("header.identifier").alias("identifier"), F.explode("metadata.metadata.element").alias("a"))
    second = top.select("identifier", F.col("a._name").alias("n1"), F.explode("a.element").alias("b"))
    # A second level may hold fields at once (no qualifier) or a third level below it.
    third = second.select("identifier", "n1", F.col("b._name").alias("n2"), F.explode_outer("b.element").alias("c"), F.col("b.field").alias("own"))
    below = third.where("c IS NOT NULL").select("identifier", F.concat_ws(".", "n1", "n2").alias("base"), F.col("c._name").alias("n3"), F.col("c.field").alias("f"), F.col("c.element").alias("d"))
    deep = below.select("identifier", F.concat_ws(".", "base", "n3").alias("name"), F.explode("d").alias("e")).select("identifier", "name", F.col("e._name").alias("lang"), F.explode("e.field").alias("x"))
    flat = below.select("identifier", F.col("base").alias("name"), F.col("n3").alias("lang"), F.explode("f").alias("x"))
    both = deep.unionByName(flat)
    return both.select("identifier", "name", F.col("x._VALUE").alias("value"), F.nullif(F.col("lang"), F.lit("none")).alias("lang"))


def headers(rows: DataFrame) -> DataFrame:
    """(page, identifier, datestamp, sets, deleted)."""
    deleted = F.coalesce(F.col("header._status") == "deleted", F.lit(False))
    return rows.select("page", F.trim("header.identifier").alias("identifier"), F.col("header.datestamp").alias("datestamp"), F.col("header.setSpec").alias("sets"), deleted.alias("deleted"))


def resumption_token(page: Column) -> Column:
    """The token of a stored page; null on the last one."""
    return F.nullif(F.trim(F.xpath_string(page, F.lit("//*[local-name()='resumptionToken']"))), F.lit(""))


def error_code(page: Column) -> Column:
    return F.nullif(F.xpath_string(page, F.lit("//*[local-name()='error']/@code")), F.lit(""))


def feed_ids(page: Column) -> Column:
    """Identifiers of the entries of a search feed: the last two parts of their URLs."""
    urls = F.xpath(page, F.lit("//*[local-name()='entry']/*[local-name()='id']/text()"))
    return F.transform(urls, lambda u: F.substring_index(F.trim(u), "/", -2))


def feed_total(page: Column) -> Column:
    return F.xpath_string(page, F.lit("//*[local-name()='totalResults']")).try_cast("int")

"""JSON lines with an explicit schema: tolerant of torn and blank lines, or strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = (), strict: bool = False, closed: bool = False) -> DataFrame:
    """Rows of a JSON-lines file, plain or gzip. Blank lines are skipped.

    ``strict``: a malformed line fails the read. Otherwise a line counts only if it parses, has the ``required`` keys and, if ``closed``,
    no key outside the schema."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        parsed = lines.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("r"))
        return parsed.select("r.*")
    wide = StructType(list(shape)).add("_corrupt_record", "string")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    keys = F.json_object_keys("value")
    parsed = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull() & keys.isNotNull())
    for name in required:
        parsed = parsed.where(F.array_contains(keys, name))
    if closed:
        parsed = parsed.where(F.size(F.array_except(keys, F.array(*map(F.lit, shape.names)))) == 0)
    return parsed.select(*[F.col(f"r.`{c}`").alias(c) for c in shape.names])


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of JSON lines; the job's commit makes it appear whole."""
    df.write.mode(mode).json(path)

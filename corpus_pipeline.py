"""The corpus pipeline: documents that are worth learning from, without repeats, mixed to target weights and encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
Repeated rows, nulls and further columns are handled as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import lexicon, line_dedup, minhash, mixing, ordinal_quality
from quern.llm.common import hidden, stage
from quern.llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal classifier, fitted on the labelled ones among them, rejects."""
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"))
    grade, tail, keep = (hidden(docs, x) for x in ("grade", "tail", "keep"))
    return ordinal_quality.score(docs, model, grade, tail, keep).where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; n_chars follows the text."""
    dropped = hidden(docs, "dropped")
    rows = line_dedup.dedup_lines(docs, dropped=dropped)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates. A doc_id goes if none of its rows is kept."""
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL")
    name = hidden(docs, "gone")
    gone = found.groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("any")).where("NOT any").select(name)
    gone = stage(gone, "pipeline-gone")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text (little-endian unsigned 32-bit integers), their number and the text that they decode to."""
    rows = lexicon.round_trip(docs, lexicon.Lexicon.of(docs, tokenizer_path()))
    kept = [c for c in rows.columns if c not in ("text", "n_tokens")]
    return rows.select(*[F.col(f"`{c}`") for c in kept], (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: SQL expresses neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

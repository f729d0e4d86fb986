"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows and bytes of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch may hold, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting (tests on one machine) gets a folder of its own.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known is None:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = context.get() if context.isDefined() else None
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends there.

    A lost executor costs at most a rerun of its own tasks; the written table survives it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the store that Spark finds it in, as ``pyarrow.fs`` reads it."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def put(spark: SparkSession, path: str, raw: bytes) -> str:
    """Writes bytes as one file that appears whole; returns its qualified path."""
    full = qualified(spark, path)
    store, inner = fs.FileSystem.from_uri(full)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(raw)
    store.move(part, inner)
    return full


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters every input bit (shift, multiply, shift)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: What each operator keeps in a Python worker from one task to the next, by operator.
_KEPT: dict[str, list] = {}


def keep(owner: str, *caches: dict) -> None:
    """Registers caches (dicts) of an operator."""
    _KEPT.setdefault(owner, []).extend(caches)


def only(owner: str) -> None:
    """Empties the caches of all other operators: a worker that runs several one after another keeps one's.

    What the allocators of Arrow and of C still hold of earlier tasks goes back to the system, so that it does not add to the JVM's share."""
    for name, caches in _KEPT.items():
        if name != owner and any(caches):
            for cache in caches:
                cache.clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def offsets_by_partition(counts: DataFrame, pid: str, amount: str) -> list[tuple[int, int]]:
    """(partition, sum of ``amount`` in the partitions before it); one row per partition reaches the driver."""
    total, out = 0, []
    for row in sorted(counts.groupBy(pid).agg(F.sum(amount).alias("_n")).collect()):
        out.append((row[0], total))
        total += row[1] or 0
    return out

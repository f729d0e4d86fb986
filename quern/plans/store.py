"""Index tables: written once in the shared folder of a session and read by every query that needs them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths by (application, key).
_BUILT: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A session on one machine that names none gets one of its own; a cluster must name one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known is None:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = context.get() if context.isDefined() else None
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def built(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key: made and written at the first call of a session, read back at all of them. ``key`` must name the input too."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _BUILT:
        path = f"{shared_dir(spark)}/quern/index-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _BUILT[at] = path
    return spark.read.parquet(_BUILT[at])

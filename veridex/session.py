"""Session helpers: lineage cuts that survive executor loss and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a reference list (sites, places, evaluation items) may be broadcast.
BROADCAST_ROWS = 20_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, cutting its lineage.

    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Where that is unset, one is made for a
    session whose executors are threads of this process (tests); a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veridex-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """As :func:`checkpoint`, but as a compressed table in the same folder: half the disk for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lets Spark remove a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def passed_on(df: DataFrame) -> DataFrame:
    """As :func:`materialize`, and the shuffle files that it took go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.set(_CLEANUP, before)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (shuffle join)."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; timestamps without zone come out as UTC instants under a UTC session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

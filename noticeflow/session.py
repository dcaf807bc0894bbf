"""Session settings and scratch space shared by operators that need them."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution, with hot join partitions split even when that adds a shuffle.

    Catalyst decides on broadcasts (by measured size, ``autoBroadcastJoinThreshold``).
    """
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where none is configured."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="noticeflow-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, fixes row placement for ranking passes."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table that is cheap to count: sent to all tasks if it has ``rows`` rows at most, else joined by shuffle.

    Spares the shuffle of a wide table where Catalyst cannot tell how little stands on the other side.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def evaluate_once(df: DataFrame) -> DataFrame:
    """Keep costly columns from being copied into later filters and projections.

    Catalyst moves filters below projections and inlines what they use, which would run a text rule
    once per reference.  A row number nobody can reason about stops both rewrites; it costs an
    addition per row and leaves column pruning and code generation intact.  Streams have no row numbers
    and stay as they are.
    """
    if df.isStreaming:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("_row") >= 0).drop("_row")

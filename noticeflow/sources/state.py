"""State tables in shared storage: snapshots, changed rows per run, and one marker that makes a run visible.

A run writes the rows it changes to a folder of its own in every table, and its marker last.  Readers take the
latest snapshot and, of the runs that have a marker, the last row per key.  A run that is repeated keeps what it
had already written whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.schemas import APPENDED, STATE_KEYS, state_schema

_COMMITS = "_commits"


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``kind=N`` below ``path``, in order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(f"{kind}=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def committed(spark: SparkSession, root: str) -> list[int]:
    """Runs that are visible."""
    return _folders(spark, f"{root}/{_COMMITS}", "batch")


def read_state(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A state table after all visible runs; an empty table when there is none.

    Columns added later are filled with nulls, so older snapshots stay readable.
    """
    schema, key = state_schema(table), STATE_KEYS[table]
    versions = _folders(spark, f"{root}/{table}", "version")
    visible = set(committed(spark, root))
    batches = [b for b in _folders(spark, f"{root}/{table}", "batch") if b in visible]
    if not versions and not batches:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{root}/{table}/version={versions[-1]}").withColumn("_batch", F.lit(-1))] if versions else []
    if not batches:
        return parts[0].drop("_batch")
    stored = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    paths = [f"{root}/{table}/batch={b}" for b in batches]
    parts.append(spark.read.schema(stored).option("basePath", f"{root}/{table}").parquet(*paths).withColumnRenamed("batch", "_batch"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if table in APPENDED:
        return rows.drop("_batch")
    rest = [c for c in schema.fieldNames() if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(
        *[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in schema.fieldNames()])


def write_state(df: DataFrame, root: str, table: str) -> DataFrame:
    """Write the next snapshot and return it as read back; readers of older ones are not disturbed."""
    spark = df.sparkSession
    versions = _folders(spark, f"{root}/{table}", "version")
    version = versions[-1] + 1 if versions else 1
    df.select(*state_schema(table).fieldNames()).write.mode("overwrite").parquet(f"{root}/{table}/version={version}")
    return read_state(spark, root, table)


def written(spark: SparkSession, root: str, table: str, batch: int) -> bool:
    """Has this run written its changes of the table whole?"""
    return batch in _folders(spark, f"{root}/{table}", "batch")


def write_changes(df: DataFrame, root: str, table: str, batch: int) -> None:
    """Write a run's changed rows, one per key; a table this run has already written whole is left as it is."""
    if not written(df.sparkSession, root, table, batch):
        df.select(*state_schema(table).fieldNames()).write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def own_changes(spark: SparkSession, root: str, table: str, batch: int) -> DataFrame:
    """What a run has written to a table, before it is visible."""
    return spark.read.schema(state_schema(table)).parquet(f"{root}/{table}/batch={batch}")


def commit(spark: SparkSession, root: str, batch: int) -> None:
    """Make all that a run has written visible at once."""
    spark.range(1).write.mode("overwrite").parquet(f"{root}/{_COMMITS}/batch={batch}")


def compact(spark: SparkSession, root: str, table: str) -> None:
    """Fold the visible runs of a table into a snapshot; the one before it stays for its readers.

    Runs are removed oldest first: those left by an interruption are newer, and applying them again gives
    the same rows.
    """
    visible = set(committed(spark, root))
    batches = [b for b in _folders(spark, f"{root}/{table}", "batch") if b in visible]
    if batches:
        write_state(read_state(spark, root, table), root, table)
        for b in batches:
            _delete(spark, f"{root}/{table}/batch={b}")
    for v in _folders(spark, f"{root}/{table}", "version")[:-2]:
        _delete(spark, f"{root}/{table}/version={v}")

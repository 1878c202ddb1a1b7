"""Session helpers: a local test session, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(app: str = "stratapanel", cpus: str = "8", partitions: int | None = None) -> SparkSession:
    """Session for tests and benchmarks; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Test panels are a few megabytes: keep them on all cores instead of one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    The folder is the one named by ``spark.checkpoint.dir``.  A lost executor re-reads the
    table instead of recomputing the branches, and readers get column pruning and real
    sizes, so small tables are broadcast by the planner's own rule.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratapanel_staged = True
    return out


def stage(df: DataFrame) -> DataFrame:
    """``materialize`` unless ``df`` itself already is a materialized frame."""
    return df if getattr(df, "_stratapanel_staged", False) else materialize(df)


def derived(df: DataFrame, rows: int) -> DataFrame:
    """Flags a frame made from a materialized one by narrow steps: reading it twice costs two scans, so it needs no copy.

    ``rows``: how many rows it has, or an upper bound.
    """
    df._stratapanel_staged, df._stratapanel_rows = True, rows
    return df


def row_count(df: DataFrame) -> int:
    """Rows of a materialized frame (from the file footers), or the number it was flagged with."""
    known = getattr(df, "_stratapanel_rows", None)
    if known is None:
        known = df._stratapanel_rows = df.count()
    return known


#: Rows that one task of a window over whole groups should get; a group above that is a task's least share.
TASK_ROWS = 1 << 18


def clustered(df: DataFrame, keys: list[str], rows: int, task_rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into tasks of about ``task_rows`` (else TASK_ROWS), whose number grows with ``rows``, so that the memory of one does not.

    A window's own exchange has a fixed number of partitions, and the planner joins them by their compressed size. Tables that are small
    for the cores at hand are left to it.
    """
    want = -(-rows // (task_rows or TASK_ROWS))
    return df if want <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(want, *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder name under the checkpoint folder, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# A DATE column has at most 3.65 million values, so a table with one row per date and a
# few scalar columns is bounded by its type, whatever the size of the fact table.
def date_dimension(df: DataFrame, key: str) -> DataFrame:
    """Broadcast a one-row-per-date table; leave the join to AQE for any other key type."""
    if isinstance(df.schema[key].dataType, T.DateType):
        return F.broadcast(df)
    return df


# Parameters (thresholds, named periods, horizons) arrive as Python lists and are
# turned into array literals: no join is needed to cross them with a frame.
def explode_literals(df: DataFrame, values: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """Repeat each row once per parameter tuple; ``columns`` gives (name, type)."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, columns)]) for row in values
    ]
    out = df.withColumn("_p", F.explode(F.array(*structs)))
    return out.select("*", *[F.col(f"_p.{n}").alias(n) for n, _ in columns]).drop("_p")

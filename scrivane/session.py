"""Session settings and the shared scratch area."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scrivane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode (tests); a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scrivane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
        pass


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared scratch folder, in a folder for each value of ``by`` if one is named, and reads it back.

    This cuts the lineage: a lost executor costs nothing that was written.
    The table is removed by release, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scrivane-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables in the scratch folder that are still there.
_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all scratch tables; to be called when the results that read them have been written."""
    while _made:
        _delete(spark, _made.pop())


@atexit.register
def _release_at_end() -> None:
    if spark := SparkSession.getActiveSession():
        release(spark)


def broadcast_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a hint to broadcast it if it has no more rows than that; any other is joined as the optimizer sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bytes a core from which an input has splits enough.
SPLIT_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df in parts enough for all cores. Only inputs that the optimizer knows to be small are moved; no job runs to find out."""
    if df.isStreaming:
        return df
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        cores = df.sparkSession.sparkContext.defaultParallelism
    except AttributeError:  # a client without access to plans
        return df
    return df.repartition(2 * cores) if size < cores * SPLIT_BYTES else df

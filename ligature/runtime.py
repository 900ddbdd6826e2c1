"""Session, checkpoint and broadcast rules that every operator follows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its plan says it is smaller than this many bytes.
BROADCAST_LIMIT_BYTES = 32 << 20


def session(app: str = "ligature", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are designed for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LIGATURE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured.

    ``spark.checkpoint.dir`` of the session wins. A machine-local folder is chosen only
    when neither it nor the context names one, and only on a local master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ligature-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, shared as they are."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, sources: list[str], make) -> DataFrame:
    """What ``make()`` gives, written as Parquet the first time in a session and read from there afterwards.

    It is made anew when one of the source paths has changed, or its files are gone.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    states = [(s, at(s).getFileSystem(conf).getFileStatus(at(s))) for s in sources]
    key = (spark.sparkContext.applicationId, name, *((s, x.getModificationTime(), x.getLen()) for s, x in states))
    path = _STORED.get(key)
    if path is None or not at(path).getFileSystem(conf).exists(at(f"{path}/_SUCCESS")):
        path = scratch(spark, name)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; never runs a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast where the estimate is under ``limit``; otherwise leave the join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores if it comes in fewer splits than there are cores, else as it is.

    For maps that cost much more than moving their input: a small file is one split. Large inputs
    have more splits than cores and are left where they lie. So is what isn't read straight from a
    source: counting its splits would run its shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().nodeName():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A key is dealt out if it has more rows than ``hot_limit``; then so many keys at most are, which bounds what is broadcast.
HOT_KEYS = 500_000


def hot_limit(total: int, least: int, keys: int = HOT_KEYS) -> int:
    """Rows above which a key is hot, of ``total`` rows: never under ``least``, and such that at most ``keys`` keys are above it."""
    return max(least, -(-total // keys))


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, least: int = 100_000, keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined to ``counted``, which has one row per key with ``n``, the key's number of rows.

    Rows of keys above ``hot_limit`` stay where they are and get their counted row by broadcast: at most
    ``keys`` rows, as ``n`` sums up to ``total``. All others meet by key. ``n`` is kept.
    """
    limit = hot_limit(total, least, keys)
    hot = counted.where(F.col("n") > limit)
    light = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(F.col("n") <= limit), on)
    return light.unionByName(rows.join(F.broadcast(hot), on))


def release(df: DataFrame) -> None:
    """Delete the checkpoint files of a frame made by :func:`cut`; nothing that is still to run may read it."""
    plan = df._jdf.queryExecution().analyzed()
    rdd = plan.rdd() if plan.nodeName() == "LogicalRDD" else None
    if rdd is not None and rdd.isCheckpointed():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

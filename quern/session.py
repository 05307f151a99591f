"""Session helpers: sensible defaults, and shipping the package to Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "quern", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as its time zone."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    if here.suffix == ".zip" or not here.is_dir():
        return
    at = tempfile.mkdtemp(prefix="quern-src-")
    shutil.copytree(here, f"{at}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/{here.name}", "zip", f"{at}/src"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by spark.checkpoint.dir; a private one only where none is set and
    the master is local, as in tests.  On a cluster without one there is no place that all see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="quern-")
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that no later step (nor a lost
    executor) recomputes what led to it.  The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan that has few partitions (one small file) dealt to all cores; others as they are.

    A scan of many or large files already has a partition for every core and is not shuffled."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return df  # it shuffles anyway
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() * 2 > cores else df.repartition(cores)

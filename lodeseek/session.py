"""Session helpers: tuned builder and durable staging of intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(app: str = "lodeseek", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow transfer switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return importable(b.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests) a temporary folder of our own is
    taken and kept in the session's settings, so that later calls find the same one. On a cluster the
    setting must be there: a folder of one machine would be another one on each executor.
    """
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT, None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError(f"{_CHECKPOINT} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodeseek-shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(_CHECKPOINT, f"file://{own}")
    return f"file://{own}"


def session_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, below a folder of this session, which goes when the session ends."""
    own = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    fs, root = file_system(spark, own)
    fs.mkdirs(root)
    fs.deleteOnExit(root)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def staged_path(df: DataFrame, label: str) -> str:
    """Where `df` was written to, a `session_path`."""
    path = session_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    This cuts the lineage with a replicated or shared copy: a lost executor costs a re-read, not a
    re-run of the stages before, and a table that is used twice is computed once.
    """
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, label))


def drop_staged(spark: SparkSession) -> None:
    """Remove all staged tables of this session before its end; results that still read them must be written by then."""
    fs, root = file_system(spark, f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    fs.delete(root, True)


def spread(spark: SparkSession) -> int:
    """How many parts a stored table is written in, so that all cores read it: the session's shuffle partitions, or its cores if those are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, and the path itself."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def importable(spark: SparkSession) -> SparkSession:
    """`spark`, whose Python workers find this package where the driver found it (on executors: at the same path)."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark

"""Session helpers: a local session for tests and benchmarks, and the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours uses. AQE re-plans shuffles at run time (partition
# coalescing, skew-join splitting); the session time zone is pinned so timestamp
# text is stable.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tabprobe") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TABPROBE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder used to cut lineage.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it from the
    session. Only a local-mode session without one gets a fresh folder under the
    system temp directory; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabprobe-ckpt-"))
        return sc.getCheckpointDir()
    raise ValueError("spark.checkpoint.dir is not set; point it at a folder shared by the cluster")


_STORED: list[str] = []


def _forget_stored(jvm, conf) -> None:
    """Delete the tables that this driver stored (when it ends in good order)."""
    for path in _STORED:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone
            return
    _STORED.clear()


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared checkpoint folder; deleted when the driver ends."""
    import atexit
    import uuid

    if not _STORED:
        atexit.register(_forget_stored, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _STORED.append(f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}")
    return _STORED[-1]


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor does not send the
    work back to the raw input), and later passes read it columnar, reading only
    the columns they use.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def forget(*tables) -> None:
    """Delete stored intermediate tables that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        # A local folder is stored as file:/x and listed as file:///x.
        for path in {re.sub("^file:/+", "file:/", f.rsplit("/", 1)[0]) for f in df.inputFiles()} & set(_STORED):
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            _STORED.remove(path)


def free_shuffles(df):
    """Let Spark delete the shuffle files of finished phases, which stay until the driver happens
    to collect its garbage: call it between phases, with the stored table that ended one."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df

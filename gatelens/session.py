"""Session settings and the shared folder that jobs write intermediate tables and checkpoints to."""

from __future__ import annotations

import tempfile
import uuid

import gatelens
from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Functions of this package travel to the Python workers with their jobs, so workers need not have it installed.
cloudpickle.register_pickle_by_value(gatelens)

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "gatelens", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one machine, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="gatelens-")
    context.setCheckpointDir(fallback)
    return context.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder for one run, in this application's folder under the shared one.

    The application's folder is deleted when its driver ends.
    """
    top = f"{shared_dir(spark)}/gatelens-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"

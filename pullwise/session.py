"""Session settings the engine relies on; everything else is left to the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a cluster run: input splits of 256 MB, and enough shuffle partitions for about 128 MB each.

    Adaptive execution merges what turns out small and splits what turns out skewed, so erring high is cheap."""
    partitions = max(2 * cores, -(-input_bytes // (128 << 20)))
    return {**SETTINGS, "spark.sql.files.maxPartitionBytes": str(256 << 20),
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def local_session(cpus: int | None = None, name: str = "pullwise") -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cpus or min(8, os.cpu_count() or 2)
    builder = (SparkSession.builder.master(f"local[{n}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(n))
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once per application, so jobs with Python code need no installation."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(root)}.zip")     # Spark's file server hands it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: the cluster's, or a temporary one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folders[app]


def clean_up(spark: SparkSession) -> None:
    """Deletes what this application has written as intermediates; call it when its results have been consumed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """A result several later steps read, written once as a table in the shared folder and read back.

    Later steps then neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_seals: dict[str, bytes] = {}


def sealed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``written`` for rows with text that must not lie in a folder in the clear: the named columns are encrypted where they are
    stored, under a key that only this application's plans hold."""
    app = df.sparkSession.sparkContext.applicationId
    key = F.lit(_seals.setdefault(app, os.urandom(16)))
    stored = written(df.withColumns({c: F.aes_encrypt(F.col(c), key) for c in columns}), name)
    return stored.withColumns({c: F.aes_decrypt(F.col(c), key).cast("string") for c in columns})

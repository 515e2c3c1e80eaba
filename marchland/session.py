"""Session helpers: settings for local use, the shared folder, and cutting lineage through written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED = None
_WRITTEN: list[str] = []


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
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
    """The folder all executors share: spark.checkpoint.dir; a local one only where the master is local and none is set."""
    global _LOCAL_SHARED
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_SHARED is None or not os.path.isdir(_LOCAL_SHARED):
        _LOCAL_SHARED = tempfile.mkdtemp(prefix="marchland-")
        atexit.register(shutil.rmtree, _LOCAL_SHARED, ignore_errors=True)
    return "file://" + _LOCAL_SHARED


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as this machine's file system has it, or None if its scheme, or the default one where it has none, is another."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return at.toUri().getPath() if scheme == "file" else None


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def forget(spark: SparkSession) -> None:
    """Removes all tables this process has written into the shared folder; call it once no result is read any more."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Cut:
    """Writes tables into the shared folder and reads them back, so that plans stay short and survive lost executors.

    ``drop(name)`` removes an older table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for Python stages: enough for all cores and small enough for one task's memory."""
    return max(parallelism(spark), -(-rows // rows_per_task))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the tasks, once a session, unless their Python finds it anyway."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or root in known or (spark.sparkContext.master.startswith("local[") and os.path.abspath(os.getcwd()) == root):
        return
    folder = mounted(spark, shared_dir(spark))
    if folder is None:  # the driver serves the file to the tasks for as long as it runs
        folder = tempfile.mkdtemp(prefix="marchland-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"marchland-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(os.path.join(root, "marchland")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the input has fewer splits than that, for expressions that cost far more than a shuffle of the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Tables that a later step reads again: written to the folder that all machines of a cluster share, so that what
follows does not depend on lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, in local runs, a temporary one."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/vantage-checkpoints"
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared one; what is in it when the session ends is removed then."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.mkdirs(path)  # only a path that is there is taken note of
    system.deleteOnExit(path)
    system.delete(path, True)
    return folder


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


class Written:
    """Tables written to the shared folder and read again. drop() removes what is no longer needed, a write that fails
    removes all of them, the end of a `with` block what is left in it, and the session's end the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folders, self.told = spark, name, {}, {}

    def __enter__(self) -> Written:
        return self

    def __exit__(self, *_: object) -> None:
        self.only()

    def put(self, key: str, frame: DataFrame, **measures: Column) -> DataFrame:
        """Write the frame and read it again; told[key] holds the measures (0 where there are no rows)."""
        folder = new_folder(self.spark, f"{self.name}-{key}")
        old = self.folders.get(key)
        if measures:
            seen = Observation()
            frame = frame.observe(seen, *(c.alias(n) for n, c in measures.items()))
        kept_shuffles = self.spark.conf.get(CLEANUP, "false")
        try:
            self.spark.conf.set(CLEANUP, "true")  # what comes next reads the table, not the shuffles behind it
            frame.write.parquet(folder)
        except Exception:
            remove(self.spark, folder)
            self.only()
            raise
        finally:
            self.spark.conf.set(CLEANUP, kept_shuffles)
        self.folders[key] = folder
        if measures:
            found = seen.get
            self.told[key] = {n: found.get(n) or 0 for n in measures}
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(frame.schema).parquet(folder)

    def drop(self, *keys: str) -> None:
        for key in keys:
            if folder := self.folders.pop(key, None):
                remove(self.spark, folder)

    def only(self, *keys: str) -> None:
        """Drop all but these."""
        self.drop(*(k for k in list(self.folders) if k not in keys))

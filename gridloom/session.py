"""Session set-up and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gridloom")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    A local session that names none, as in tests, gets one; any other has to name one.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and found.isDefined():
        return found.get()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "gridloom-shared")
    if not found.isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Paths of this process that ``clear_scratch`` deletes.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; ``clear_scratch`` deletes what is there."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete all that this process has written to scratch paths, and tell how many there were.

    DataFrames that still read from them, such as results that have not been written, are
    lost; call it when a job's results are.
    """
    n = len(_MADE)
    while _MADE:
        drop_path(spark, _MADE.pop())
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path``, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one job in the shared folder; each can be dropped once nothing reads it.

    A table that is written and read again cuts lineage as a checkpoint does, takes less
    room, and has no files for empty partitions.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder = spark, scratch_path(spark, what)

    def keep(self, name: str, data: DataFrame) -> DataFrame:
        """``data`` as written under ``name`` and read again."""
        data.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(data.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; all of them for an empty name."""
        for name in names:
            drop_path(self.spark, f"{self.folder}/{name}".rstrip("/"))

"""Tables in the folder that all executors share: lineage starts anew there, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (local master only) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append("file://" + tempfile.mkdtemp(prefix="peptrail-"))
    return _local_folder[0]


class Scratch:
    """Tables written below the shared folder, so that lost executors never lose them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.rows: dict[str, int] = {}

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str, counted: bool = False) -> DataFrame:
        """Write df and return it as read back: its lineage starts at the written files. counted: how many rows were written goes to rows[tag], without a job of its own."""
        path, seen = self.path(tag), Observation()
        with shuffles_end(self.spark):
            (df.observe(seen, F.count(F.lit(1)).alias("rows")) if counted else df).write.parquet(path)
        if counted:
            self.rows[tag] = self.rows.get(tag, 0) + int(seen.get.get("rows") or 0)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in dfs:
            if getattr(df, "scratch_path", None):
                delete(self.spark, df.scratch_path)

    def close(self) -> None:
        """Delete all tables; no plan that reads one may run any more."""
        delete(self.spark, self.root)


#: Spark deletes the shuffle files of a query that runs while this is on, as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: what they write is all that is read again. The session's own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows

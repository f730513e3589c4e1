"""Written intermediate tables: how iterative operators cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and one machine runs all."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "step") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that sorts (some 50 MB); of one where smaller tasks would make Spark sort what it writes as well; and
#: those for which a further task pays.
TASK_ROWS, MOST_ROWS, LEAST_ROWS = 400_000, 2_000_000, 20_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` for a window over them, to as many tasks as its rows take, which are counted first.

    So a task's memory does not follow the number of partitions that the session
    shuffles to or merges them into. Up to the partitions of
    ``spark.shuffle.sort.bypassMergeThreshold`` rows are written as they come;
    beyond them, a task that reads a file's part holds and sorts all of it.
    """
    sc, rows = df.sparkSession.sparkContext, df.count()
    unsorted = int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    by_size = min(rows // TASK_ROWS, max(rows // MOST_ROWS, unsorted - 1))
    return df.repartition(max(by_size, min(rows // LEAST_ROWS, sc.defaultParallelism - 1)) + 1, *keys)


class Grown:
    """A table that rounds append to: each round writes its own rows only, and reads see all of them."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema = first.sparkSession, first.schema
        self.root, self.parts = fresh_path(self.spark), 0
        self.last = self.append(first)

    def append(self, rows: DataFrame) -> DataFrame:
        """Write rows as the next part and return them as read back."""
        path = f"{self.root}/part={self.parts}"
        rows.write.parquet(path)
        self.parts += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/part={k}" for k in range(self.parts)])

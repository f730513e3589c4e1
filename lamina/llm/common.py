"""Helpers shared by the corpus operators: materialised tables, Arrow batches, class ids."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Send a module's functions to the Python workers by value, so that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset and one machine runs all."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        return


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts may be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Names of a row's key.
ROW = ["row_a", "row_b"]


def row_key(df: DataFrame, *columns: str) -> list[Column]:
    """128 bits of a row's id and text (or other columns): rows of one id with other texts differ, and a null id is a value like others."""
    held = [F.col(c).cast("string") for c in columns or ("doc_id", "text")]
    marked = [x for c in held for x in (c, c.isNull())]
    return [F.xxhash64(*marked).alias(ROW[0]), F.xxhash64(F.lit(7), *marked).alias(ROW[1])]


def sent(keys: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked to be broadcast if it has up to ``BROADCAST_ROWS`` of them."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key ``gone`` holds."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs))
    return row.join(sent(written(gone.select(*ROW).distinct())), ROW, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once (a lambda would compute an outer expression anew for each element)."""
    return F.transform(F.array(value), use)[0]


#: Rows of narrow tables that are broadcast; hot keys that are broadcast beyond that.
BROADCAST_ROWS, HOT_KEYS = 200_000, 10_000


def meet(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to a narrow table of distinct ``keys``, whatever share of the rows one key holds.

    A table of up to ``BROADCAST_ROWS`` rows is broadcast. Beyond that, the keys
    whose ``weight`` (their number of rows) is over 1/``HOT_KEYS`` of the sum are
    fewer than ``HOT_KEYS`` and are broadcast; the others are shuffled.
    """
    size = keys.agg(F.count("*").alias("n"), F.sum(weight).alias("w")).first()
    if size["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    hot = F.col(weight) * HOT_KEYS > size["w"]
    return rows.join(F.broadcast(keys.where(hot)), on, how).unionByName(rows.join(keys.where(~hot).hint("merge"), on, how))


#: Edges of a task.
TASK_EDGES = 25_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row ``(id, comp)`` per end, comp the smallest id reachable.

    Large-star / small-star rounds: linear in the edges, logarithmically many
    rounds. Minima are pre-aggregated, and they are written before they are joined
    back to the edges: both sides of that join then are plain exchanges, which
    Spark splits where a hub's edges fill one. A round's tables have a part for
    each ``TASK_EDGES`` edges, so that few edges cost few tasks, however many
    partitions the session shuffles to. The driver only learns how many edges there
    are and whether a round changed anything.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.expr("struct(count(*), bit_xor(xxhash64(u, v)), sum(cast(xxhash64(v, u) as decimal(20))))").alias("mark")
    before = e.agg(mark).first()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(before["mark"][0] // TASK_EDGES + 1)

    while before["mark"][0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        # Large star: every larger neighbour is linked to the least id around its centre.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(dealt(large.where("u <> v").distinct()))
        least = written(dealt(large.groupBy("u").agg(F.min("v").alias("m"))))
        # Small star: a node and its smaller neighbours are linked to the least of them.
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nxt = written(dealt(small.where("u <> v").distinct()))
        after = nxt.agg(mark).first()
        if after == before:
            break
        e, before = nxt, after
    ends = dealt(e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp"))
    return ends.union(dealt(ends.select(F.col("comp").alias("id"), "comp").distinct()))


ship(__name__)

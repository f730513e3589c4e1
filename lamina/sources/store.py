"""Content-addressed object tables: lookup, append, subtree export, remote copies, connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.graph import closure
from lamina.operators.versions import transfer


class ObjectStore:
    """Objects as a Parquet folder partitioned by kind; appends add only what is missing, so each hash is held once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = "hash string, inclusive_hash string, kind string, body string") -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def objects(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        try:
            return reader.parquet(self.folder)
        except Exception as e:  # an empty store has no folder yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def put(self, rows: DataFrame) -> int:
        """Append what is missing; returns how many objects that were. One writer at a time."""
        new = transfer(rows.select(*self.objects().columns), self.objects()).persist()
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("kind").parquet(self.folder)
        new.unpersist()
        return n

    def contains(self, hashes: DataFrame) -> DataFrame:
        """``hash, held`` of a table of hashes."""
        own = self.objects().select("hash").distinct().withColumn("held", F.lit(True))
        return hashes.select("hash").distinct().join(own, "hash", "left").select("hash", F.coalesce("held", F.lit(False)).alias("held"))

    def subtree(self, roots: DataFrame, children: DataFrame) -> DataFrame:
        """``root`` and the objects below each root, itself included; what a remote store sends as one answer."""
        below = closure(roots.select(F.col("hash").alias("id")), children)
        return below.join(self.objects(), below.id == F.col("hash")).select("root", *self.objects().columns)

    def get(self, *hashes: str) -> DataFrame:
        return self.objects().where(F.col("hash").isin(*hashes))

    def by_inclusive_hash(self, value: str) -> DataFrame:
        """The first object by hash with that inclusive hash."""
        return self.objects().where(F.col("inclusive_hash") == value).orderBy("hash").limit(1)


class MemoryStore(ObjectStore):
    """The same contract over a table of the session; nothing is written."""

    def __init__(self, spark: SparkSession, schema: str = "hash string, inclusive_hash string, kind string, body string") -> None:
        super().__init__(spark, "", schema)
        self.held = spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        return self.held

    def put(self, rows: DataFrame) -> int:
        new = transfer(rows.select(*self.held.columns), self.held).persist()
        n = new.count()
        if n:
            self.held = self.held.unionByName(new)
        return n


class RemoteStore(ObjectStore):
    """A store that another writer owns, read where it lies (any path that Spark reads); the transport is the file system's."""

    def put(self, rows: DataFrame) -> int:
        raise PermissionError("a remote store takes objects by push only")

    def fetch(self, into: ObjectStore) -> int:
        """Copy what the other store lacks; returns how many objects that were."""
        return into.put(self.objects())


def dag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``parent, ord, change`` between two trees of children ``(parent, ord, kind, hash)``: equal hashes are not entered, unlike kinds are a removal and an addition."""
    x, y = (df.select("parent", "ord", F.col("kind").alias(f"kind_{n}"), F.col("hash").alias(f"hash_{n}")) for df, n in ((a, "a"), (b, "b")))
    j = x.join(y, ["parent", "ord"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    change = F.when(F.col("hash_a").isNull(), F.array(F.lit("added"))).when(F.col("hash_b").isNull(), F.array(F.lit("removed"))).when(F.col("kind_a") != F.col("kind_b"), F.array(F.lit("removed"), F.lit("added"))).when(F.col("kind_a") == "text", F.array(F.lit("text-changed"))).otherwise(F.array(F.lit("changed")))
    return j.select("parent", "ord", F.explode(change).alias("change"))


def export_tree(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """``path, xml`` of a tree's entries, by path."""
    return entries.join(documents.select("document", "xml"), "document").select("path", "xml")


def subscriptions(accesses: DataFrame) -> DataFrame:
    """Who is subscribed to what at the end of ``accesses(conn, repo, kind, at)``: any access subscribes, a later disconnect of the connection ends it."""
    last_off = accesses.where("kind = 'disconnect'").groupBy("conn").agg(F.max("at").alias("off"))
    on = accesses.where("kind <> 'disconnect'").groupBy("conn", "repo").agg(F.max("at").alias("seen"))
    return on.join(last_off, "conn", "left").where("off is null or seen > off").select("conn", "repo")


def open_transactions(events: DataFrame) -> DataFrame:
    """``conn, n_open`` at the end of ``events(conn, kind, at)``: begins less ends behind the last disconnect, which rolls back."""
    off = events.where("kind = 'disconnect'").groupBy("conn").agg(F.max("at").alias("off"))
    live = events.join(off, "conn", "left").where("off is null or at > off")
    return live.groupBy("conn").agg((F.count_if(F.col("kind") == "begin") - F.count_if(F.col("kind").isin("commit", "rollback"))).alias("n_open")).where("n_open > 0")

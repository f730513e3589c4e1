"""A stream gives what the table gives."""

from __future__ import annotations

from lamina.sources.store import ObjectStore
from lamina.streaming.refs import bursts, deliveries, maintain, on_change, stream_subscriptions, stream_transactions, stream_updates, updates


def test_ref_updates_of_a_stream(spark, tmp_path):
    rows = [("r", "main", f"h{i}", f"c{i % 2}", i) for i in range(6)] + [("r", "dev", "x", "c0", 3)]
    df = spark.createDataFrame(rows, "repo string, name string, hash string, origin string, ts long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_updates(stream).writeStream.format("memory").queryName("ref_updates").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["name"], r["old"] or "", r["new"]) for r in spark.sql("select * from ref_updates").collect())
    table = updates(df.where("name = 'main'"), "name", ["ts"], "hash")
    assert got == sorted([("dev", "", "x"), *((r["name"], r["old"] or "", r["new"]) for r in table.collect())])


def test_store_appends_only_what_is_missing(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "objects"))
    rows = spark.createDataFrame([("a", "i", "text", "1"), ("b", "i", "element", "2"), ("a", "i", "text", "1")], store.schema)
    assert (store.put(rows), store.put(rows)) == (2, 0)
    assert store.get("b").first()["body"] == "2"
    assert store.by_inclusive_hash("i").first()["hash"] == "a"


def run_stream(spark, tmp_path, parts, schema, operator, name):
    """Rows of an append stream over files that come one after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    q = operator(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.sql(f"select * from {name}").collect())


def test_transactions_of_a_stream(spark, tmp_path):
    parts = [[("a", "begin", 1), ("b", "commit", 1), ("a", "begin", 2)], [("a", "commit", 3), ("a", "disconnect", 4), ("b", "begin", 5)], [("b", "rollback", 6)]]
    got = run_stream(spark, tmp_path, parts, "conn string, kind string, at long", stream_transactions, "transactions")
    assert got == [("a", 1, "begun", 1), ("a", 2, "begun", 2), ("a", 3, "committed", 1), ("a", 4, "rolled back", 0), ("b", 1, "nothing open", 0), ("b", 5, "begun", 1), ("b", 6, "rolled back", 0)]


def test_subscriptions_of_a_stream(spark, tmp_path):
    parts = [[("a", "r", "read", 1), ("a", "r", "read", 2)], [("a", "s", "read", 3), ("a", None, "disconnect", 4)], [("a", "r", "read", 5)]]
    got = run_stream(spark, tmp_path, parts, "conn string, repo string, kind string, at long", stream_subscriptions, "subscribed")
    assert got == [("a", "r", 1, "subscribed"), ("a", "r", 4, "ended"), ("a", "r", 5, "subscribed"), ("a", "s", 3, "subscribed"), ("a", "s", 4, "ended")]


def test_updates_go_to_the_others(spark):
    moves = spark.createDataFrame([("r", "main", None, "1", "a"), ("s", "main", "1", "2", None)], "repo string, name string, old string, new string, origin string")
    subscribed = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", "s")], "conn string, repo string")
    assert sorted((r["conn"], r["new"]) for r in deliveries(moves, subscribed).collect()) == [("b", "1"), ("b", "2")]


def test_bursts_end_after_a_pause(spark):
    rows = spark.createDataFrame([("k", 0), ("k", 1), ("k", 9), ("j", 1)], "key string, s long").selectExpr("key", "timestamp_seconds(s) as ts")
    assert sorted((r["key"], r["n"]) for r in bursts(rows, "key", "ts", "2 seconds").collect()) == [("j", 1), ("k", 1), ("k", 2)]


def test_upkeep_and_regeneration_follow_a_stream(spark, tmp_path):
    schema = "id string, node_hash string, ts long"
    index, batches = {}, []
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for q in (maintain(stream, lambda df: index.update({r["id"]: r["node_hash"] for r in df.collect()})), on_change(stream, lambda df, n: batches.append((n, df.count())))):
        q.processAllAvailable()
        q.stop()
    assert index == {"a": "2", "b": "1"} and batches == [(0, 3)]

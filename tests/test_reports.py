"""Reports and text functions on small tables whose results are known."""

from __future__ import annotations

import textwrap

from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.model import fragment
from lamina.operators import reports as P


def test_wrapped_lines(spark):
    texts = ["", "one", "a bb ccc dddd eeeee ffffff", "averyveryverylongword and short", "  spaced   out  words "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.wrapped(F.col("t"), 10).alias("w"))
    assert [r["w"] for r in df.collect()] == [textwrap.wrap(" ".join(t.split()), 10, break_long_words=False, break_on_hyphens=False) for t in texts]


def test_names_and_exemptions(spark):
    row = spark.createDataFrame([("a/b.RS", "type-x", "n1", None, "other")], "p string, a string, b string, c string, d string")
    got = row.select(T.language_of(F.col("p")), T.is_exempt(F.col("a"), F.col("c")), T.is_exempt(F.col("b"), F.col("c")), T.is_exempt(F.col("b"), F.col("d")), T.matches_any(F.col("p")), T.number_after(F.lit('{"score": 42}'), "score"), T.number_after(F.lit("none"), "score")).first()
    assert tuple(got) == ("rust", True, False, True, True, 42, None)


def test_diff_metrics(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@\n-old\n+new\n+def test_it():\n+++ b/y.rs\n+    fn test_more() {\n same"
    assert P.diff_metrics(spark.createDataFrame([("r", diff)], "run string, diff string"), "run").first().asDict() == {"run": "r", "added": 3, "removed": 1, "files": 2, "tests": 2}


def test_arms_and_runs(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("c", None)], "arm string, v double")
    assert {r["arm"]: (r["mean"], r["delta"]) for r in P.arm_summary(rows, "arm", "v", "a").collect()} == {"a": (1.5, 0.0), "b": (4.0, 2.5), "c": (0.0, -1.5)}
    runs = spark.createDataFrame([("v", 2.0, False, "win"), ("v", 4.0, False, "tie"), ("v", 9.0, True, None)], "variant string, cost double, failed boolean, verdict string")
    got = P.run_summary(runs, "variant", "cost", F.col("failed"), "verdict", ("win", "loss")).first()
    assert got.asDict() == {"variant": "v", "total": 15.0, "mean": 3.0, "most": 4.0, "errors": 1, "won_win": 1, "won_loss": 0}


def test_spans_lists_and_orphans(spark):
    spans = spark.createDataFrame([("i", "a", 1), ("i", "b", 9), ("i", "b", 4), ("j", "a", 2)], "id string, file string, pre int")
    details = spark.createDataFrame([("i", "x"), ("k", "y")], "id string, layer string")
    assert [tuple(r) for r in P.last_spans(spans, details).collect()] == [("i", "b", 4, "x")]
    nodes = spark.createDataFrame([("n",), ("m",), ("n",)], "id string")
    edges = spark.createDataFrame([("z", "n", "m"), ("y", "n", "m"), ("y", "n", "n")], "type string, src string, dst string")
    assert {r["id"]: (r["outgoing"], r["incoming"]) for r in P.relation_lists(nodes, edges).collect()} == {"n": (["y", "z"], ["y"]), "m": ([], ["y", "z"])}
    rows = spark.createDataFrame([(1, "n"), (2, "q"), (3, None)], "k int, ref string")
    assert [r["k"] for r in P.orphans(rows, "ref", nodes, "id").collect()] == [2]


def test_fragments(spark):
    df = spark.createDataFrame([("a\nb\nc\n", 2, 3), ("a\nb", None, None)], "t string, s int, e int")
    assert [r[0] for r in df.select(fragment(F.col("t"), F.col("s"), F.col("e"))).collect()] == ["    2 | b\n    3 | c", "    1 | a\n    2 | b"]

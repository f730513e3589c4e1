"""Operators on small tables whose results are known."""

from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lamina.functions import hashing as H
from lamina.operators import coverage as C
from lamina.operators import graph as G
from lamina.operators import repository as R
from lamina.operators import search as S
from lamina.operators import tables as T
from lamina.operators import versions as V
from lamina.operators.xmldiff import diff_documents, merge_documents
from lamina.plans.xpath import XPathError, evaluate
from lamina.sources import xml as X

LANDS = (
    '<atlas xmlns:geo="urn:atlas"><!-- drawn by hand --><geo:land id="l1" rank="low" area="30"><geo:label>Fjordland</geo:label><river/><river/></geo:land>'
    '<geo:land id="l22" rank="high" area="7"><geo:label> Marsh  and\n moor </geo:label><river/></geo:land><land id="old">sunken</land></atlas>'
)
NS = {"geo": "urn:atlas"}


@pytest.fixture(scope="module")
def nodes(spark):
    return X.shred(spark.createDataFrame([("a.xml", LANDS), ("bad.xml", "<a><b></a>"), ("none.xml", None)], "path string, content string")).cache()


@pytest.mark.parametrize(
    ("xpath", "expected"),
    [
        ("//geo:land/@area", ["30", "7"]),
        ("/atlas/geo:land[@rank='low']/geo:label", ["Fjordland"]),
        ("//geo:land[contains(@id,'22')]/@rank", ["high"]),
        ("//geo:land[starts-with(@id,'l')][not(@rank='low')]/@id", ["l22"]),
        ("//geo:label[normalize-space(.)='Marsh and moor']/../@id", ["l22"]),
        ("(//geo:land)[last()]/@id", ["l22"]),
        ("(//river)[2]/../@id", ["l1"]),
        ("/atlas/descendant::geo:land[geo:label='Fjordland']/@area", ["30"]),
        ("//land | //geo:land[1]/geo:label", ["Fjordland", "sunken"]),
        ("//geo:land[@area > 10]/@id", ["l1"]),
        ("//geo:land[@area <= 7 or @rank='none']/@id", ["l22"]),
        ("//geo:land[count(river) >= 2]/@id", ["l1"]),
        ("//geo:land[count(lake) = 0]/@id", ["l1", "l22"]),
        ("//*[string-length(@id) = 3]/@id", ["l22", "old"]),
        ("/atlas/*[position() < 3]/@id", ["l1", "l22"]),
        ("//geo:land[@id='l1']/following-sibling::land", ["sunken"]),
        ("//land/preceding-sibling::geo:land[2]/@id", ["l22"]),
        ("//river/ancestor::geo:land/@rank", ["high", "low"]),
        ("//geo:label/ancestor-or-self::*[@rank='high']/@id", ["l22"]),
        ("string(//geo:land)", ["Fjordland"]),
        ("//nowhere", []),
    ],
)
def test_xpath(nodes, xpath, expected):
    assert sorted(r["value"] for r in evaluate(nodes, xpath, "text", NS).collect()) == expected


def test_xpath_errors_and_modes(nodes):
    for bad in ("//[", "//geo:land[", "sea:x", "//a[@b=]", "", "//a[position()]", "//a[count(b)]", "/a/uncle::b"):
        with pytest.raises(XPathError):
            evaluate(nodes, bad, "text", NS)
    with pytest.raises(ValueError, match="invalid query mode"):
        evaluate(nodes, "//a", "html")
    assert evaluate(nodes, "count(//geo:land)", "text", NS).first()["n"] == 2
    assert [r["path"] for r in X.well_formed(nodes).orderBy("path").collect()] == ["bad.xml", "none.xml"]


def test_deep_and_broken_documents(spark):
    n = 3000
    deep = "".join(f"<e{i % 3}>" for i in range(n)) + "x" + "".join(f"</e{i % 3}>" for i in reversed(range(n)))
    rows = X.rows_of("d", deep, hashes=False)
    assert len(rows) == n + 2 and rows[-1]["level"] == n + 1 and rows[0]["last"] == n + 1
    assert X.string_value(X.parse(deep)) == "x" and X.digest(X.parse(deep)).startswith("sha256:")
    files = spark.createDataFrame([("d", deep, deep.replace(">x<", ">y<"), deep), ("b", "<a>", "<a/>", "<a/>"), ("g", "<a/>", "<a p='1'/>", "<a><b/></a>")], "path string, a string, o string, t string")
    got = {r["path"]: r for r in merge_documents(files).collect()}
    assert got["b"]["error"] and got["b"]["xml"] is None
    assert got["g"]["xml"] == '<a p="1"><b/></a>' and got["g"]["error"] is None and ">y<" in got["d"]["xml"]
    changes = diff_documents(files.select("path", "a", F.col("o").alias("b"))).collect()
    assert [(r["change"], r["old"], r["new"]) for r in changes if r["path"] == "d"] == [("text-changed", "x", "y")]
    assert [r["change"] for r in changes if r["path"] == "b"] == ["error"]


def test_export_gives_the_same_nodes(nodes):
    again = X.shred(X.export(nodes.where("path = 'a.xml'")).selectExpr("path", "xml as content"))
    pick = lambda df: sorted((r["local_name"], r["hash"]) for r in df.where("kind = 'element'").collect())
    assert pick(again) == pick(nodes.where("path = 'a.xml'"))


def test_canonical_form():
    root = X.parse('<a xmlns="u" b="2" a="1"><!-- c --><b/>&lt;</a>')
    assert X.canonical(root.children[0]) == '<a xmlns="u" a="1" b="2"><b></b>&lt;</a>'
    inner = X.parse('<x:a xmlns:x="u" xmlns:y="v"><x:b/></x:a>').children[0].children[0]
    assert X.canonical(inner, exclusive=True) == '<x:b xmlns:x="u"></x:b>'
    assert X.canonical(inner) == '<x:b xmlns:x="u" xmlns:y="v"></x:b>'


def test_hashes(spark):
    import hashlib

    row = spark.createDataFrame([("ab",)], "s string").select(H.text_hash(F.col("s")).alias("t"), H.file_hash(F.col("s")).alias("f")).first()
    once = hashlib.sha256(b"ab")
    assert row["t"] == "sha256:" + once.hexdigest()
    assert row["f"] == "sha256:" + hashlib.sha256(once.digest()).hexdigest()


def test_betweenness_against_all_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "a"), ("x", "x")]
    ids = sorted({v for e in edges for v in e})
    n = spark.createDataFrame([(i, "t") for i in ids], "id string, tag string")
    e = spark.createDataFrame([("t", a, b, None) for a, b in edges], "type string, src string, dst string, to_spec string")

    def paths(a, b):
        level = [[a]]
        while level:
            hit = [p for p in level if p[-1] == b]
            if hit:
                return hit
            level = [[*p, y] for p in level for x, y in edges if x == p[-1] and y not in p]
        return []

    want = dict.fromkeys(ids, 0.0)
    for a, b in permutations(ids, 2):
        found = paths(a, b)
        for v in ids:
            if v not in (a, b) and found:
                want[v] += sum(v in p for p in found) / len(found)
    k = (len(ids) - 1) * (len(ids) - 2)
    got = {r["id"]: r["score"] for r in G.betweenness(n, e).collect()}
    assert got == pytest.approx({v: s / k for v, s in want.items() if s})


def test_components_and_cycles(spark):
    n = spark.createDataFrame([(c, "t") for c in "abcdefg"], "id string, tag string")
    e = spark.createDataFrame([("depends-on", "a", "b", None), ("references", "b", "a", None), ("refines", "b", "c", None), ("refines", "d", "e", None), ("precedes", "f", "f", None), ("refines", "a", "zz", None)], "type string, src string, dst string, to_spec string")
    assert {r["component"]: r["size"] for r in G.component_sizes(n, e).collect()} == {"a": 3, "d": 2, "f": 1, "g": 1}
    got = {r["component"]: (r["members"], r["types"], r["violation"]) for r in G.cycles(n, e).collect()}
    assert got == {"a": (["a", "b"], ["depends-on", "references"], True), "f": (["f"], ["precedes"], True)}


@pytest.mark.parametrize(
    ("a", "o", "t", "outcome", "merged"),
    [
        ("1", "1", "1", "kept", "1"),
        ("1", "2", "1", "ours_only", "2"),
        ("1", "1", "2", "theirs_only", "2"),
        ("1", "2", "2", "auto_merged", "2"),
        ("1", "2", "3", "conflict", "2"),
        (None, "1", None, "ours_only", "1"),
        (None, None, "1", "theirs_only", "1"),
        (None, "1", "1", "auto_merged", "1"),
        (None, "1", "2", "conflict", "1"),
        ("1", None, "1", "ours_only", None),
        ("1", None, "2", "conflict", "1"),
        ("1", "1", None, "theirs_only", None),
        ("1", "2", None, "conflict", "2"),
        ("1", None, None, "dropped", None),
    ],
)
def test_three_way(spark, a, o, t, outcome, merged):
    side = lambda v: spark.createDataFrame([("p", v)] if v else [], "path string, document string")
    r = V.three_way(side(a), side(o), side(t), ["path"], "document").first()
    assert (r["outcome"], r["merged"]) == (outcome, merged)


def test_histories(spark):
    parents = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("z", "y")], "commit string, parent string")
    rows = V.log(spark.createDataFrame([("d",)], "commit string"), parents).orderBy("position").collect()
    assert [r["commit"] for r in rows] == ["d", "b", "c", "a"]
    pairs = spark.createDataFrame([("b", "c"), ("b", "z"), ("d", "b")], "a string, b string")
    assert {(r["a"], r["b"]): r["ancestor"] for r in V.common_ancestors(pairs, parents).collect()} == {("b", "c"): "a", ("d", "b"): "b"}


def test_long_chain_and_shortcuts(spark):
    n = 10_000
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("c9000", "c10")]  # one commit has a second parent far behind
    parents = spark.createDataFrame(chain, "commit string, parent string")
    got = {r["commit"]: r["depth"] for r in V.history(spark.createDataFrame([(f"c{n - 1}",)], "commit string"), parents).collect()}
    want = {f"c{i}": n - 1 - i for i in range(n)} | {f"c{i}": 999 + 1 + 10 - i for i in range(11)}
    assert got == want


def test_histories_against_a_walk(spark):
    r = random.Random(2)
    arcs = sorted({(f"{i:02d}", f"{r.randrange(i):02d}") for i in range(1, 40) for _ in range(r.choice([1, 1, 1, 2, 3]))})
    starts = ["39", "38", "05", "00"]
    want = {}
    for s in starts:
        level, depth = {s}, 0
        while level:
            want |= {(s, c): depth for c in level if (s, c) not in want}
            level, depth = {p for c, p in arcs if c in level and (s, p) not in want}, depth + 1
    got = V.history(spark.createDataFrame([(s,) for s in starts], "commit string"), spark.createDataFrame(arcs, "commit string, parent string"))
    assert {(x["start"], x["commit"]): x["depth"] for x in got.collect()} == want


def test_strong_components_against_reachability(spark):
    r = random.Random(3)
    ids = [f"{i:02d}" for i in range(24)]
    arcs = {(r.choice(ids), r.choice(ids)) for _ in range(34)} | {(f"{i:02d}", f"{(i + 1) % 6:02d}") for i in range(6)}
    reach = {a: {b for x, b in arcs if x == a} for a in ids}
    for _ in ids:
        reach = {a: reach[a] | {c for b in reach[a] for c in reach[b]} for a in ids}
    want = {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids if a in reach[a]}
    got = G.strong_components(spark.createDataFrame(sorted(arcs), "src string, dst string"))
    assert {x["id"]: x["component"] for x in got.collect()} == want
    assert G.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_covered_lines_against_brute_force(spark):
    r = random.Random(4)
    files = [(f"f{i}", "\n".join(r.choice(["x", "", " \t"]) for _ in range(r.randrange(12))) + r.choice(["", "\n"])) for i in range(30)]
    ranges = [(p, a, b) for p, _ in files for _ in range(r.randrange(4)) for a in [r.choice([None, -2, 0, 1, 3, 5, 20])] for b in [None if a is None else a + r.randrange(-1, 6)]]
    got = {(x["path"], x["line"]): (x["filled"], x["covered"]) for x in C.covered_lines(spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(ranges, "path string, start_line int, end_line int")).collect()}
    want = {}
    for p, text in files:
        own = [(a, b) for q, a, b in ranges if q == p]
        lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
        if own:
            want |= {(p, i): (bool(x.strip()), all(a is None for a, _ in own) or any(a is not None and a <= i <= b for a, b in own)) for i, x in enumerate(lines, 1)}
    assert got == want


def test_transactions(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1)], "hash string, v int")
    tx = R.Transaction(table)
    tx.put(spark.createDataFrame([("b", 2), ("c", 2)], "hash string, v int"))
    tx.put(spark.createDataFrame([("c", 3)], "hash string, v int"))
    done = tx.commit()
    assert sorted(tuple(x) for x in done.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    for call in (tx.commit, tx.rollback, lambda: tx.put(table)):
        with pytest.raises(RuntimeError, match="already committed"):
            call()
    other = R.Transaction(done)
    other.put(table)
    assert other.rollback().count() == 3 and other.state == "rolled back"


def test_compare_and_set(spark):
    refs = spark.createDataFrame([("m", "1"), ("d", "1"), ("x", "1")], "name string, hash string")
    asked = spark.createDataFrame([("m", "1", "2"), ("d", "0", "2"), ("x", "1", None), ("n", None, "5"), ("m", None, "9"), ("q", "1", "2")], "name string, expected string, value string")
    after, outcomes = R.compare_and_set(refs, asked)
    done = {(r["name"], r["expected"]): r["done"] for r in outcomes.collect()}
    assert done == {("m", "1"): False, ("m", None): False, ("d", "0"): False, ("x", "1"): True, ("n", None): True, ("q", "1"): False}
    assert sorted(tuple(r) for r in after.collect()) == [("d", "1"), ("m", "1"), ("n", "5")]


def test_clone_takes_heads_and_names_the_default_branch(spark):
    f = lambda rows: spark.createDataFrame(rows, "name string, hash string")
    objects = spark.createDataFrame([("1",), ("1",), ("2",)], "hash string")
    heads, copied, head = R.clone(f([("refs/heads/a", "1"), ("refs/heads/main", "2"), ("refs/tags/t", "1")]), objects)
    assert sorted(r["name"] for r in heads.collect()) == ["refs/heads/a", "refs/heads/main"]
    assert copied.count() == 2 and head.first()["target"] == "refs/heads/main"
    assert R.clone(f([("refs/heads/z", "1"), ("refs/heads/b", "1")]), objects)[2].first()["target"] == "refs/heads/b"
    assert R.clone(f([]), objects)[2].count() == 0


def test_pull_moves_only_a_clean_copy(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    own, remote = f([("refs/heads/main", "1")], "name string, hash string"), f([("refs/heads/main", "2"), ("refs/tags/t", "9")], "name string, hash string")
    parents = f([("2", "1")], "commit string, parent string")
    tree, none = f([("p", "h")], "path string, hash string"), f([], "path string, action string, hash string")
    refs, plan, obstacles = R.pull(own, remote, parents, tree, tree, none, tree)
    assert (refs.first()["hash"], plan.first()["step"], obstacles.count()) == ("2", "fast-forward", 0)
    dirty = f([("p", "other"), ("q", "mine")], "path string, hash string")
    refs, plan, obstacles = R.pull(own, remote, parents, tree, dirty, none, f([("p", "h"), ("q", "h2")], "path string, hash string"))
    assert (refs.first()["hash"], plan.first()["step"]) == ("1", "blocked")
    assert sorted(tuple(r) for r in obstacles.collect()) == [("p", "modified"), ("q", "would be overwritten")]


def test_searches_refuse_what_they_cannot_send(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_QUERIES", 1)
    rows = spark.createDataFrame([(1, [1.0], [1]), (2, [0.0], [0])], "id int, embedding array<double>, bits array<long>")
    asked = rows.selectExpr("id as query_id", "embedding as q_embedding", "bits as q_bits")
    assert S.top_k(rows, asked.where("query_id = 1")).count() == 2
    with pytest.raises(ValueError, match="ask in parts"):
        S.top_k(rows, asked)


def test_uncovered_runs(spark):
    files = spark.createDataFrame([("f", "a\n\nb\nc\nd\n"), ("w", "x\n\n")], "path string, content string")
    ranges = spark.createDataFrame([("f", 4, 4), ("w", None, None)], "path string, start_line int, end_line int")
    lines = C.covered_lines(files, ranges)
    assert [tuple(r) for r in C.uncovered_runs(lines).orderBy("first").collect()] == [("f", 1, 1), ("f", 3, 3), ("f", 5, 5)]
    assert {r["path"]: r["percent"] for r in C.file_coverage(lines).collect()} == {"f": 25.0, "w": 100.0}


def test_status_has_every_state(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    w = f([("same", "1"), ("mod", "1"), ("gone", "1"), ("staged", "1")], "path string, hash string")
    d = f([("same", "1"), ("mod", "2"), ("new", "3"), ("staged", "9")], "path string, hash string")
    g = f([("staged", "modify", "9")], "path string, action string, hash string")
    assert {r["path"]: r["state"] for r in V.status(w, d, g).collect()} == {"mod": "modified", "gone": "deleted", "new": "untracked", "staged": "staged-modify"}


def test_siblings_are_numbered_in_tasks_of_bounded_rows(spark, monkeypatch):
    """However few partitions the session shuffles to, and sorted once."""
    monkeypatch.setattr(T, "TASK_ROWS", 50, raising=False)
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(400)]), rng.choice("ab"), i, rng.choice([None, None, f"i{i}"])) for i in range(2000)]
    children = spark.createDataFrame(rows, "parent long, name string, ord int, id string")
    alike = {}
    for parent, name, at, _ in rows:
        alike.setdefault((parent, name), []).append(at)
    segments = {at: f'{name}[@id="{key}"]' if key else f"{name}[{alike[parent, name].index(at) + 1}]" if len(alike[parent, name]) > 1 else name for parent, name, at, key in rows}
    occurrences = {at: alike[parent, name].index(at) for parent, name, at, _ in rows}
    for out, added, expected in ((V.segments(children), "segment", segments), (V.child_keys(children, names=("name",)), "occurrence", occurrences)):
        found = out.withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == len(rows) and {r["ord"]: r[added] for r in found} == expected
        tasks = [r["task"] for r in found]
        assert max(map(tasks.count, set(tasks))) < 200
        assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


@pytest.mark.parametrize(("rows", "size", "most", "tasks"), [(0, 10, 100, 1), (900, 10, 100, 91), (2500, 10, 100, 200), (2500, 10, 11, 228)])
def test_tasks_follow_the_rows(spark, monkeypatch, rows, size, most, tasks):
    """Beyond 200, where a task sorts what it writes, there are more only for ``MOST_ROWS``."""
    monkeypatch.setattr(T, "TASK_ROWS", size)
    monkeypatch.setattr(T, "MOST_ROWS", most)
    assert T.dealt(spark.range(rows), "id").rdd.getNumPartitions() == tasks

"""Reports over runs, arms, diffs, references and query results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: lines of a diff that declare a test.
TEST_LINE = r"^\s*(?:async\s+)?(?:def test_\w+|fn test_\w+|it\()"


def run_summary(runs: DataFrame, group: str, cost: str, failed: Column, verdict: str | None = None, verdicts: tuple[str, ...] = ()) -> DataFrame:
    """``group, total, mean, most, errors`` and ``won_<v>`` per verdict: totals count failed runs, means and maxima do not."""
    good = F.when(~failed, F.col(cost))
    wins = [F.count_if(F.col(verdict) == v).alias(f"won_{v}") for v in verdicts] if verdict else []
    return runs.groupBy(group).agg(F.round(F.sum(cost), 4).alias("total"), F.round(F.avg(good), 6).alias("mean"), F.max(good).alias("most"), F.count_if(failed).alias("errors"), *wins)


def phase_costs(events: DataFrame, group: str, phase: str, value: str, prefixes: tuple[str, ...], minute: float = 60_000) -> DataFrame:
    """``group, phase_<prefix>, per_minute``: sums of the phases that start with a prefix, and events a minute of all (0 where none passed)."""
    sums = [F.round(F.sum(F.when(F.col(phase).startswith(p), F.col(value))), 4).alias(f"phase_{p}") for p in prefixes]
    total = F.sum(value)
    rate = F.when(total == 0, 0.0).otherwise(F.count("*") / (total / minute))
    return events.groupBy(group).agg(*sums, F.round(rate, 4).alias("per_minute"))


def diff_metrics(diffs: DataFrame, group: str, text: str = "diff") -> DataFrame:
    """``group, added, removed, files, tests``: lines of unified diffs by their marks; file headers count as files only."""
    lines = diffs.select(group, F.explode(F.split(text, "\n")).alias("s"))
    s = F.col("s")
    added, removed = s.startswith("+") & ~s.startswith("+++"), s.startswith("-") & ~s.startswith("---")
    header = F.when(s.startswith("+++ "), F.substring("s", 5, 10_000))
    tests = added & F.substring("s", 2, 10_000).rlike(TEST_LINE)
    return lines.groupBy(group).agg(F.count_if(added).alias("added"), F.count_if(removed).alias("removed"), F.countDistinct(header).alias("files"), F.count_if(tests).alias("tests"))


def arm_summary(rows: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """``arm, mean, delta`` against one arm: means to two places (0 where there is none), the delta taken before rounding."""
    means = rows.groupBy(F.col(arm).alias("arm")).agg(F.avg(value).alias("m"))
    first = means.where(F.col("arm") == base).select(F.col("m").alias("b"))  # one row at most
    j = means.join(F.broadcast(first), F.lit(True), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("arm", F.round(zero("m"), 2).alias("mean"), F.round(zero("m") - zero("b"), 2).alias("delta"))


def counters(edges: DataFrame, types: dict[str, str]) -> DataFrame:
    """``id`` and a count of incoming edges per ``name: type``."""
    return edges.groupBy(F.col("dst").alias("id")).agg(*[F.count_if(F.col("type") == t).alias(n) for n, t in types.items()])


def edges_by_type(edges: DataFrame) -> DataFrame:
    """``type, targets, n``: what each type of edge points to, each once, in order."""
    return edges.groupBy("type").agg(F.array_sort(F.collect_set("dst")).alias("targets"), F.count("*").alias("n"))


def relation_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, outgoing, incoming``: the types of each node's relations, each once, in order; empty where there are none."""
    none = F.array().cast("array<string>")
    sides = [edges.groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_set("type")).alias(name)) for end, name in (("src", "outgoing"), ("dst", "incoming"))]
    joined = reduce(lambda a, b: a.join(b, "id", "left"), sides, nodes.select("id").distinct())
    return joined.select("id", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """``src, dst, n`` of edges between different ends."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def orphans(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose value is no target's; null values point to nothing and are none."""
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(target).alias(column)).distinct(), column, "left_anti")


def last_spans(spans: DataFrame, details: DataFrame) -> DataFrame:
    """``spans(id, file, pre, ...)`` that count, with their ``details(id, ...)``: of an id's spans that of the last file, there the first."""
    rest = [c for c in spans.columns if c != "id"]
    chosen = spans.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("file", (-F.col("pre")).alias("minus"))).alias("s"))
    return chosen.select("id", "s.*").join(details, "id")


def joined_results(results: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """``document, n, texts``: a query's results per document, counted and joined by newlines in their order."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("x"))))
    return results.groupBy(document).agg(F.count("*").alias("n"), parts.alias("p")).select(document, "n", F.array_join(F.transform("p", lambda x: x["x"]), "\n").alias("texts"))


def first_nodes(nodes: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, pre, text``: of nodes that share a key the first."""
    return nodes.groupBy(key).agg(F.min(order).alias("pre"), F.min_by(text, order).alias("text"))

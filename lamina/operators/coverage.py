"""Coverage of nodes by mappings and of lines by ranges; drift; validation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import lines, strength


def node_coverage(nodes: DataFrame, mapped: DataFrame, exempt: DataFrame) -> DataFrame:
    """One row: ``total, mapped, exempt, unmapped``; mapped counts distinct ids, nodes or not; exempt those not mapped."""
    n, m, x = (df.select("id").distinct() for df in (nodes, mapped, exempt))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rest = n.join(m, "id", "left_anti").join(x, "id", "left_anti")
    return count(n, "total").crossJoin(count(m, "mapped")).crossJoin(count(x.join(m, "id", "left_anti"), "exempt")).crossJoin(count(rest, "unmapped"))


def unmapped(nodes: DataFrame, mapped: DataFrame, exempt: DataFrame) -> DataFrame:
    return nodes.select("id").distinct().join(mapped.select("id"), "id", "left_anti").join(exempt.select("id"), "id", "left_anti")


def mapping_lines(ranges: DataFrame) -> DataFrame:
    """``id, line_count, strength`` of ``id, start_line, end_line`` ranges; 0 where lines are missing."""
    n = F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1).otherwise(0)
    per = ranges.groupBy("id").agg(F.sum(n).cast("long").alias("line_count"))
    return per.withColumn("strength", strength(F.col("line_count")))


def covered_lines(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """``path, line, filled, covered`` of ``files(path, content)`` under ``ranges(path, start_line, end_line)``.

    Ranges are gathered per file, cut to its lines and made disjoint; lines and
    ranges meet inside the row, by sets, in time linear in the lines. A file with
    whole-file ranges only (no lines) is covered throughout.
    """
    per = ranges.groupBy("path").agg(F.array_sort(F.collect_set(F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.struct(F.col("start_line").cast("int").alias("a"), F.col("end_line").cast("int").alias("b"))))).alias("r"))
    wide = files.join(per, "path").select("path", "r", lines(F.col("content")).alias("ls"))
    n = F.size("ls")
    # One pass over the sorted ranges: each gives the lines behind those that are covered already.
    step = lambda acc, r: F.struct(F.greatest(acc["end"], r["b"]).alias("end"), F.concat(acc["spans"], F.array(F.struct(F.greatest(r["a"], acc["end"] + 1, F.lit(1)).alias("a"), F.least(r["b"], n).alias("b")))).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    spans = F.filter(F.aggregate("r", start, step, lambda acc: acc["spans"]), lambda x: x["a"] <= x["b"])
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hit = F.when(F.size("r") == 0, every).otherwise(F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["b"]))))
    split = wide.select("path", "ls", hit.alias("hit"), F.array_except(every, hit).alias("free"))
    row = lambda is_hit: lambda i: F.struct(i.alias("line"), F.lit(is_hit).alias("covered"))
    rows = split.select("path", F.explode(F.transform(F.array(F.struct("ls", F.concat(F.transform("hit", row(True)), F.transform("free", row(False))).alias("all"))), lambda s: F.transform(s["all"], lambda x: F.struct(x["line"].alias("line"), x["covered"].alias("covered"), F.get(s["ls"], x["line"] - 1).alias("text"))))[0]).alias("x"))
    return rows.select("path", "x.line", (F.trim(F.regexp_replace("x.text", r"\s+", " ")) != "").alias("filled"), "x.covered")


def file_coverage(covered: DataFrame) -> DataFrame:
    """``path, n_filled, n_covered, percent``; 100 where no line is filled."""
    filled, hit = F.count_if("filled"), F.count_if(F.col("filled") & F.col("covered"))
    return covered.groupBy("path").agg(filled.alias("n_filled"), hit.alias("n_covered"), F.when(filled > 0, 100.0 * hit / filled).otherwise(100.0).alias("percent"))


def uncovered_runs(covered: DataFrame) -> DataFrame:
    """``path, first, last``: maximal runs of filled lines that are not covered."""
    open_lines = covered.where("filled and not covered")
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return open_lines.withColumn("island", island).groupBy("path", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).select("path", "first", "last")


def with_current(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``mappings(id, node, node_hash)`` with ``now``, the hash their node has; null where the node is gone."""
    return mappings.join(nodes.select("node", F.col("hash").alias("now")), "node", "left")


def drift(mappings: DataFrame, nodes: DataFrame, ranges: DataFrame, files: DataFrame) -> DataFrame:
    """``id, status`` of each mapping: spec-drifted, artifact-drifted, unavailable or clean; the spec side comes first, then ranges in order.

    ``mappings(id, node, node_hash)``, ``nodes(node, hash)``, ``ranges(id, ord, path, hash)``, ``files(path, hash)``; a node that is not found gives no signal.
    """
    eligible = lambda c: F.col(c).startswith("sha256:") & (F.col(c) != "sha256:placeholder")
    spec = with_current(mappings, nodes).select("id", F.when(eligible("node_hash") & (F.col("now") != F.col("node_hash")), "spec-drifted").alias("spec"))
    checked = ranges.join(files.select("path", F.col("hash").alias("file_hash")), "path", "left").where(eligible("hash"))
    bad = checked.select("id", "ord", F.when(F.col("file_hash").isNull(), "unavailable").when(F.col("file_hash") != F.col("hash"), "artifact-drifted").alias("s")).where("s is not null")
    first = bad.groupBy("id").agg(F.min_by("s", "ord").alias("artifact"))
    return spec.join(first, "id", "left").select("id", F.coalesce("spec", "artifact", F.lit("clean")).alias("status"))


def drift_summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("spec-drifted", "artifact-drifted")).alias("drifted"))


def duplicate_ids(rows: DataFrame, order: str = "ord") -> DataFrame:
    """``id, path, first_path``: every later holder of an id, with the first one. A grouped minimum and a join, no window over a hot id."""
    first = rows.groupBy("id").agg(F.min(F.struct(order, "path")).alias("m"), F.count("*").alias("n")).where("n > 1").select("id", F.col(f"m.{order}").alias("first_ord"), F.col("m.path").alias("first_path"))
    return rows.join(first, "id").where(F.col(order) != F.col("first_ord")).select("id", "path", "first_path")


def check_keyrefs(keys: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``rule, value, n`` of values without a target, for rules ``name: (rows, column, targets, column)``."""
    out = None
    for rule, (rows, column, targets, target) in keys.items():
        missing = rows.select(F.col(column).alias("value")).where("value is not null").join(targets.select(F.col(target).alias("value")), "value", "left_anti")
        one = missing.groupBy(F.lit(rule).alias("rule"), F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def fixed_hashes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``id, old, new`` of stored hashes that differ from the current ones; rows without a stored or current hash are skipped."""
    return stored.select("id", F.col("hash").alias("old")).join(current.select("id", F.col("hash").alias("new")), "id").where("old is not null and new is not null and old <> new")

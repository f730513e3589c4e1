"""Cross-site boilerplate lines by distinct-site spread (DataFrame functions only).

Texts are read once to hash their lines (128 bits); the hashes are written as a
table. Lines that occur on fewer rows than sites are asked for are left by a
pre-aggregated count. Of the others, a HyperLogLog sketch of the sites a line
occurs on is built by partial aggregation and merged, so a line that a third of
all rows hold shuffles one sketch per task. Lines whose estimate is well above
``min_sites`` are boilerplate; lines near the threshold get an exact count of
distinct sites, over pairs that are made distinct before they are shuffled. Of a
boilerplate line, the first occurrence (least doc_id, digest of site and text, line)
stays where ``keep_first`` is set, so groups of copies do not vanish as a whole.

Lines are compared without white space at their ends; empty lines are never
boilerplate. Null texts have no lines and stay null; a null site is a site of
its own. A row is told apart by its doc_id, site and text: rows of one id with
other texts lose their own lines only, rows that are repeated as a whole all
lose the same. Null ids sort first and lose lines like others. Whole texts are
processed, whatever their length. An empty table gives an empty result. The
result has the input's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bound, meet, unused, written

MIN_SITES = 8
#: Share of the threshold within which estimates are replaced by exact counts (several standard errors of the sketch).
NEAR = 0.35
LG_K = 9
HASH = ["a", "b"]


def _site(site: str) -> Column:
    """A name per site; null is none of the others."""
    return F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit(""))


def _text() -> Column:
    return F.col("text").cast("string")


def _key(site: str) -> Column:
    return F.md5(F.concat(_site(site), F.lit("\n"), F.coalesce(_text(), F.lit(""))))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row per non-empty line: hash ``a, b``, ``site``, the row's ``id`` and ``key``, line number ``at`` (from 0); written once."""
    trimmed = F.transform(F.split(_text(), "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")))
    pair = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    rows = docs.where("text is not null").select(F.col("doc_id").alias("id"), _key(site).alias("key"), _site(site).alias("site"), F.transform(trimmed, pair).alias("h"))
    return written(rows).select("id", "key", "site", F.posexplode("h").alias("at", "h")).where("h is not null").select("h.a", "h.b", "site", "id", "key", "at")


def spread(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Boilerplate lines: hash, number of sites (estimated, or exact near the threshold), rows, first occurrence."""
    return _spread(_common(lines_of(docs, site), min_sites), min_sites)


def _common(lines: DataFrame, min_sites: int) -> DataFrame:
    """Occurrences of the lines that enough rows hold."""
    often = written(lines.groupBy(*HASH).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_sites))
    return written(meet(lines, often, HASH, "n_rows"))


def _spread(common: DataFrame, min_sites: int) -> DataFrame:
    sketched = common.groupBy(*HASH).agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
        F.max("n_rows").alias("n_rows"),
        F.min(F.struct("id", "key", "at")).alias("first"),
    )
    often = sketched.select(*HASH, F.hll_sketch_estimate("sketch").alias("est"), "n_rows", "first")
    often = written(often.where(F.col("est") >= min_sites * (1 - NEAR)))
    clear = often.where(F.col("est") > min_sites * (1 + NEAR)).select(*HASH, F.col("est").alias("n_sites"), "n_rows", "first", F.lit(False).alias("exact"))
    near = often.where(F.col("est") <= min_sites * (1 + NEAR))
    pairs = meet(common.select(*HASH, "site"), near.select(*HASH, "n_rows"), HASH, "n_rows", "left_semi").distinct()
    exact = pairs.groupBy(*HASH).agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return written(clear.unionByName(near.join(exact, HASH).select(*HASH, "n_sites", "n_rows", "first", F.lit(True).alias("exact"))))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, site: str = "source") -> DataFrame:
    """``id, key`` of rows and the numbers ``gone`` of their lines that go."""
    common = _common(lines_of(docs, site), min_sites)
    hit = meet(common.drop("n_rows"), _spread(common, min_sites).select(*HASH, "n_rows", "first"), HASH, "n_rows")
    if keep_first:
        hit = hit.where(~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    return hit.groupBy("id", "key").agg(F.collect_set("at").alias("gone"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, site: str = "source", count: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``count``, the number of lines removed (under the next unused name if taken)."""
    gone = removals(docs, min_sites, keep_first, site)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"), _key(site).alias("row_key"), _text().alias("whole"))
    joined = row.join(gone, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")

    def kept(x: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(stays, lambda i: F.get(x["lines"], i)), "\n")

    text = F.when(F.col("gone").isNull() | F.col("whole").isNull(), F.col("whole")).otherwise(bound(F.struct(F.split("whole", "\n").alias("lines"), "gone"), kept))
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], n.alias(unused(docs, count)))


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per row: ``doc_id, n_removed``, ``n_chars_left`` and ``text_sha256`` of the text that stays."""
    cleaned = remove_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    left = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_removed", F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"))


def oracle(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce('=' || source, '') AS site FROM documents),
lines AS (
    SELECT rid, doc_id, md5(site || chr(10) || text) AS key, site, i - 1 AS pos, raw, trim(translate(raw, chr(9) || chr(13), '  '), ' ') AS line
    FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows)),
boiler AS (
    SELECT line, min({{'id': doc_id, 'key': key, 'pos': pos}}) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
marked AS (
    SELECT l.rid, l.pos, l.raw, b.line IS NOT NULL AND (l.doc_id, l.key, l.pos) <> (b.first.id, b.first.key, b.first.pos) AS gone FROM lines l LEFT JOIN boiler b USING (line)),
cleaned AS (
    SELECT rid, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY rid)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, length(coalesce(c.text, '')) AS n_chars_left, sha256(coalesce(c.text, '')) AS text_sha256
FROM rows d LEFT JOIN cleaned c USING (rid)"""

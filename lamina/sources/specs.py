"""Specs as node tables: index discovery, mappings, relations, catalogs, schema annotations, validation, chunks.

All operators read the node table of :func:`lamina.sources.xml.shred`; element
names are local names within namespaces that the caller gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.coverage import duplicate_ids


def attr(name: str) -> Column:
    """Value of an attribute without a namespace, null where absent."""
    return F.get(F.filter("attrs", lambda a: (a["local_name"] == name) & a["ns_uri"].isNull()), 0)["value"]


def elements(nodes: DataFrame, ns: str, *names: str) -> DataFrame:
    return nodes.where((F.col("kind") == "element") & (F.col("ns_uri") == ns) & F.col("local_name").isin(*names))


def resolved(base: Column, href: Column) -> Column:
    """A relative path against the folder of a file: ``..`` and ``.`` are worked off."""
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), href))
    parts = F.filter(F.split(joined, "/"), lambda p: p != ".")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def index_files(nodes: DataFrame, spec_ns: str, index_ns: str) -> DataFrame:
    """``path`` of index files: the root is the spec element and has an index entry as a direct child; other roots are followed by their ``index`` attribute."""
    roots = nodes.where("level = 1 and kind = 'element'")
    entries = elements(nodes, index_ns, "file").where("level = 2").select("path").distinct()
    own = roots.where((F.col("ns_uri") == spec_ns)).select("path").join(entries, "path", "left_semi")
    index = F.get(F.filter("attrs", lambda a: (a["local_name"] == "index") & (a["ns_uri"] == spec_ns)), 0)["value"]
    followed = roots.withColumn("href", index).where("href is not null").select(resolved(F.col("path"), F.col("href")).alias("path"))
    return own.union(followed).distinct()


def spec_files(nodes: DataFrame, index: DataFrame, index_ns: str) -> DataFrame:
    """``index, ord, path``: the files an index lists, missing ones dropped, repeated ones kept, the index itself last."""
    known = nodes.select("path").distinct()
    listed = elements(nodes, index_ns, "file").join(index.select("path"), "path", "left_semi").select(F.col("path").alias("index"), F.col("pre").alias("ord"), resolved(F.col("path"), attr("href")).alias("path")).where("path is not null")
    found = listed.join(known, "path", "left_semi").select("index", "ord", "path")
    last = F.lit(2**62).cast("long").alias("ord")
    own = index.select(F.col("path").alias("index"), last, F.col("path")).join(found.select("index", "path"), ["index", "path"], "left_anti").select("index", "ord", "path")
    return found.unionByName(own)


def catalog(nodes: DataFrame) -> DataFrame:
    """``name, uri`` of a catalog's direct ``uri`` entries that have both."""
    rows = nodes.where("kind = 'element' and level = 2 and local_name = 'uri'").select(attr("name").alias("name"), attr("uri").alias("uri"))
    return rows.where("name is not null and uri is not null")


def relations(nodes: DataFrame, ns: str) -> DataFrame:
    """``type, src, dst, to_spec`` of explicit relations; a missing attribute is an empty text."""
    text = lambda n: F.coalesce(attr(n), F.lit(""))
    return elements(nodes, ns, "relation").select(text("type").alias("type"), text("from").alias("src"), text("to").alias("dst"), attr("to-spec").alias("to_spec"))


def mappings(nodes: DataFrame, ns: str) -> DataFrame:
    """Mappings at any depth with their node, artifact and ranges; numbers that cannot be read are null."""
    m = elements(nodes, ns, "mapping").select("path", F.col("pre").alias("m_pre"), F.col("last").alias("m_last"), attr("id").alias("id"))
    inner = elements(nodes, ns, "spec-ref", "artifact", "range").select(
        "path", "pre", "local_name", attr("node").alias("node"), attr("node-hash").alias("node_hash"), attr("revision").alias("revision"), attr("path").alias("artifact_path"), attr("repo").alias("repo"), attr("hash").alias("hash"),
        *[F.expr(f"try_cast(get(filter(attrs, a -> a.local_name = '{n}'), 0).value as bigint)").alias(n.replace("-", "_")) for n in ("start-line", "end-line", "start-byte", "end-byte")],
    )
    j = m.join(inner, (m.path == inner.path) & (inner.pre > m.m_pre) & (inner.pre <= m.m_last), "left").drop(inner.path)
    first = lambda c, kind: F.min_by(F.when(F.col("local_name") == kind, F.col(c)), F.when(F.col("local_name") == kind, F.col("pre")))
    spans = F.array_sort(F.collect_list(F.when(F.col("local_name") == "range", F.struct("pre", "hash", "start_line", "end_line", "start_byte", "end_byte"))))
    return j.groupBy("path", "m_pre", "id").agg(first("node", "spec-ref").alias("node"), first("node_hash", "spec-ref").alias("node_hash"), first("revision", "spec-ref").alias("revision"), first("artifact_path", "artifact").alias("artifact_path"), first("repo", "artifact").alias("repo"), spans.alias("ranges"))


def listing(mapped: DataFrame) -> DataFrame:
    """One row per mapping and range; a range without both lines stands for the whole file."""
    r = mapped.select("id", "node", "artifact_path", "node_hash", F.explode_outer("ranges").alias("r"))
    whole = F.col("r.start_line").isNull() | F.col("r.end_line").isNull()
    return r.select("id", "node", "artifact_path", "node_hash", F.when(whole, "whole file").otherwise(F.concat_ws("-", "r.start_line", "r.end_line")).alias("lines"))


def annotated_values(nodes: DataFrame, xsd_ns: str, ns: str, element: str, wanted: str) -> DataFrame:
    """``value`` of schema enumerations or elements below which ``ns:element`` has ``value="true"`` (acyclic types) or stands at all (content elements)."""
    outer = elements(nodes, xsd_ns, wanted).select("path", F.col("pre").alias("o"), "last", F.coalesce(attr("value"), attr("name")).alias("value"))
    mark = elements(nodes, ns, element).where(F.coalesce(attr("value"), F.lit("true")) == "true").select("path", F.col("pre").alias("p"))
    hit = outer.join(mark, (outer.path == mark.path) & (mark.p > outer.o) & (mark.p <= outer.last))
    return hit.select("value").where("value is not null").distinct()


def holders(nodes: DataFrame) -> DataFrame:
    """``id, path, ord`` of all bare and xml ids, in one space."""
    ids = F.filter(F.array("id", "xml_id"), lambda x: x.isNotNull())
    return nodes.where("kind = 'element'").select(F.explode(ids).alias("id"), "path", F.struct("path", "pre").alias("ord"))


def validate(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """``path, rule, detail`` of everything wrong: ill-formed files, repeated ids, relation ends that are no ids."""
    bad = nodes.where("kind = 'error'").select("path", F.lit("well-formed").alias("rule"), F.col("text").alias("detail"))
    ids = holders(nodes)
    again = duplicate_ids(ids).select("path", F.lit("unique-id").alias("rule"), F.concat("id", F.lit(" first in "), "first_path").alias("detail"))
    ends = edges.where("to_spec is null").select(F.explode(F.array("src", "dst")).alias("id")).where("id <> '' and not startswith(id, 'type-')").distinct()
    lost = ends.join(ids.select("id"), "id", "left_anti").select(F.lit(None).cast("string").alias("path"), F.lit("reference").alias("rule"), F.col("id").alias("detail"))
    none = files.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("path"), F.lit("index").alias("rule"), F.lit("no index files found").alias("detail"))
    return reduce(DataFrame.unionByName, [bad, again, lost, none])


def rule_violations(nodes: DataFrame, ns: str, required: dict[str, list[str]], enums: dict[tuple[str, str], list[str]], patterns: dict[tuple[str, str], str]) -> DataFrame:
    """The subset of schema rules that are checked: required attributes, enumerations and patterns, per element name."""
    parts = []
    for name, attrs in required.items():
        for a in attrs:
            parts.append(elements(nodes, ns, name).where(attr(a).isNull()).select("path", "pre", F.lit(f"{name}/@{a} is missing").alias("problem")))
    for (name, a), allowed in enums.items():
        parts.append(elements(nodes, ns, name).where(~attr(a).isin(*allowed)).select("path", "pre", F.lit(f"{name}/@{a} is not allowed").alias("problem")))
    for (name, a), pattern in patterns.items():
        parts.append(elements(nodes, ns, name).where(~attr(a).rlike(f"^(?:{pattern})$")).select("path", "pre", F.lit(f"{name}/@{a} does not match").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def schema_elements(nodes: DataFrame, xsd_ns: str) -> DataFrame:
    """``path, name, type, quantifier`` of element declarations; only 0, 1 and unbounded are told apart."""
    low, high = F.coalesce(attr("minOccurs"), F.lit("1")), F.coalesce(attr("maxOccurs"), F.lit("1"))
    q = F.when(high == "unbounded", F.when(low == "0", "*").otherwise("+")).when(low == "0", "?").otherwise("")
    return elements(nodes, xsd_ns, "element").select("path", F.coalesce(attr("name"), attr("ref")).alias("name"), attr("type").alias("type"), q.alias("quantifier"))


def synthesised(nodes: DataFrame, rules: dict[str, tuple[str, str, str]]) -> DataFrame:
    """``type, src, dst``: for each rule ``type: (ns, element, attribute)`` an edge from the nearest element with an id around a reference; each once, no loops."""
    parts = []
    for kind, (ns, name, a) in rules.items():
        parts.append(elements(nodes, ns, name).select(F.lit(kind).alias("type"), F.try_element_at("ancestor_ids", F.lit(-1)).alias("src"), attr(a).alias("dst")))
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null and src <> dst").distinct()


def first_existing(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``id, path``: of each id's candidate paths ``(id, ord, path)`` the first that is known."""
    return candidates.join(known.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", "ord").alias("path"))

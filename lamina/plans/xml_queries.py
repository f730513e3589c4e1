"""XML queries: nations and conversations written as documents, shredded and queried by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import xml_escaped
from lamina.plans.registry import Tables, query
from lamina.plans.xpath import evaluate
from lamina.sources import xml as X

NS = {"geo": "urn:atlas"}


def region_files(t: Tables) -> DataFrame:
    """A document per region: its nations as items with an id, a status and a name."""
    item = F.concat(
        F.lit('<geo:land id="n'), F.col("n_nationkey").cast("string"), F.lit('" rank="'), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"), F.lit('"><geo:label>'), xml_escaped(F.col("n_name")), F.lit("</geo:label></geo:land>")
    )
    per = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))).alias("a"))
    body = F.array_join(F.transform("a", lambda s: s["x"]), "\n")
    return per.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit('<atlas xmlns:geo="urn:atlas"><!-- lands -->'), body, F.lit("</atlas>")).alias("content"))


def nodes(t: Tables) -> DataFrame:
    return X.shred(region_files(t))


PATH = "'r' || n_regionkey || '.xml'"


@query("src5_shred", f"SELECT {PATH} AS path, 2 * count(*) + 1 AS elements, count(*) AS texts FROM nation GROUP BY n_regionkey")
def src5(t: Tables) -> DataFrame:
    n = nodes(t)
    return n.groupBy("path").agg(F.count_if(F.col("kind") == "element").alias("elements"), F.count_if((F.col("kind") == "text") & (F.trim("text") != "\n") & (F.col("level") > 2)).alias("texts"))


@query("prj1_xpath_items", f"SELECT {PATH} AS path, n_name AS value FROM nation WHERE n_nationkey % 2 = 0")
def prj1(t: Tables) -> DataFrame:
    return evaluate(nodes(t), "//geo:land[@rank='even']/geo:label", "text", NS).select("path", "value")


@query("prj2_xpath_count", f"SELECT {PATH} AS path, count(*) AS n FROM nation GROUP BY n_regionkey")
def prj2(t: Tables) -> DataFrame:
    return evaluate(nodes(t), "/atlas/geo:land", "count", NS)


@query("agg17_count", f"SELECT {PATH} AS path, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def agg17(t: Tables) -> DataFrame:
    return evaluate(nodes(t), "count(//geo:land[@rank='even'])", "text", NS)


@query("prj3_xpath_ids", "SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey < 20 AND n_nationkey >= 10 OR n_nationkey = 1")
def prj3(t: Tables) -> DataFrame:
    return evaluate(nodes(t), "//geo:land[starts-with(@id, 'n1')]", "ids", NS)


@query("win6_xpath_positions", f"SELECT {PATH} AS path, arg_min(n_name, n_nationkey) AS first, arg_max(n_name, n_nationkey) AS last FROM nation GROUP BY n_regionkey")
def win6(t: Tables) -> DataFrame:
    n = nodes(t)
    first, last = (evaluate(n, f"/atlas/geo:land[{p}]/geo:label", "text", NS).select("path", F.col("value").alias(k)) for p, k in (("1", "first"), ("last()", "last")))
    return first.join(last, "path")


@query("set1_assemble", f"SELECT {PATH} AS path, 'n' || n_nationkey AS id, row_number() OVER (ORDER BY {PATH}, n_nationkey) AS place FROM nation")
def set1(t: Tables) -> DataFrame:
    """The children of all roots as one tree: where each land stands in it."""
    from pyspark.sql import Window

    lands = X.assemble(nodes(t)).where("local_name = 'land'")
    return lands.select("path", "id", F.row_number().over(Window.orderBy("gpre")).cast("long").alias("place"))


@query("src6_import_objects", "SELECT n_nationkey AS k, 'sha256:' || sha256('<geo:label xmlns:geo=\"urn:atlas\">' || n_name || '</geo:label>') AS hash FROM nation")
def src6(t: Tables) -> DataFrame:
    n = nodes(t)
    item = n.where("local_name = 'land'").select("path", F.col("pre").alias("parent_pre"), F.substring("id", 2, 10).cast("int").alias("k"))
    return n.where("local_name = 'label'").select("path", "parent_pre", "hash").join(item, ["path", "parent_pre"]).select("k", "hash")


@query("fn2_canonical_form", "SELECT n_nationkey AS k, 'sha256:' || sha256('<geo:label xmlns:geo=\"urn:atlas\">' || n_name || '</geo:label>') AS hash FROM nation")
def fn2(t: Tables) -> DataFrame:
    n = nodes(t)
    item = n.where("local_name = 'land'").select("path", F.col("pre").alias("parent_pre"), F.substring("id", 2, 10).cast("int").alias("k"))
    return n.where("local_name = 'label'").select("path", "parent_pre", F.col("inclusive_hash").alias("hash")).join(item, ["path", "parent_pre"]).select("k", "hash")


@query("snk3_export_round_trip", f"SELECT {PATH} AS path, 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS rank, n_name AS label FROM nation")
def snk3(t: Tables) -> DataFrame:
    again = X.shred(X.export(nodes(t)).select("path", F.col("xml").alias("content")))
    land = again.where("local_name = 'land'").select("path", "pre", "id", F.get(F.filter("attrs", lambda a: a["local_name"] == "rank"), 0)["value"].alias("rank"))
    return land.join(evaluate(again, "//geo:land/geo:label", "text", NS).withColumn("pre", F.col("pre") - 1).withColumnRenamed("value", "label"), ["path", "pre"]).select("path", "id", "rank", "label")


@query("val1_well_formed", f"SELECT DISTINCT {PATH} AS path, n_regionkey % 2 = 0 AS ok FROM nation")
def val1(t: Tables) -> DataFrame:
    """Every other region's document lacks its last closing tag."""
    files = region_files(t)
    broken = files.select("path", F.when(F.substring("path", 2, 1).cast("int") % 2 == 1, F.replace("content", F.lit("</atlas>"), F.lit(""))).otherwise(F.col("content")).alias("content"))
    bad = X.well_formed(X.shred(broken, hashes=False)).select("path", F.lit(False).alias("ok"))
    return files.select("path").join(bad, "path", "left").select("path", F.coalesce("ok", F.lit(True)).alias("ok"))


@query("val2_unique_ids", f"SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey || '.xml.copy' AS path, {PATH} AS first_path FROM nation")
def val2(t: Tables) -> DataFrame:
    """The files twice: each id of a copy stands first in the original."""
    from lamina.operators.coverage import duplicate_ids
    from lamina.sources import specs as S

    files = region_files(t)
    both = files.unionByName(files.withColumn("path", F.concat("path", F.lit(".copy"))))
    return duplicate_ids(S.holders(X.shred(both, hashes=False))).select("id", "path", "first_path")


@query("sea1_chunks", f"SELECT 'n' || n_nationkey AS id, {PATH} AS file, '[layer=test path=atlas>land]' || chr(10) || n_name AS text FROM nation")
def sea1(t: Tables) -> DataFrame:
    from lamina.functions.text import chunk_text

    n = nodes(t)
    values = evaluate(n, "//geo:land", "text", NS)
    own = n.where("id is not null").select("path", "pre", "id", "ancestor_names", "local_name")
    return own.join(values, ["path", "pre"]).select("id", F.col("path").alias("file"), chunk_text(F.lit("test"), F.concat("ancestor_names", F.array("local_name")), F.col("value")).alias("text"))


def changed_files(t: Tables) -> DataFrame:
    """Region documents with some nations' statuses turned and names changed."""
    a = region_files(t)
    b = a.select("path", F.regexp_replace("content", r'id="n(\d*[37])" rank="(even|odd)"', 'id="n$1" rank="gone"').alias("b"))
    return a.withColumnRenamed("content", "a").join(b, "path")


@query("grf7_xml_diff", f"SELECT {PATH} AS path, 'attribute-changed' AS change, '/atlas/land[@id=\"n' || n_nationkey || '\"]/@rank' AS at, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS old, 'gone' AS new FROM nation WHERE n_nationkey % 10 IN (3, 7)")
def grf7(t: Tables) -> DataFrame:
    from lamina.operators.xmldiff import diff_documents

    return diff_documents(changed_files(t))


@query(
    "jon13_xml_merge",
    f"""SELECT {PATH} AS path, 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 10 IN (3, 7) THEN 'gone' WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS rank, 0 AS conflicts FROM nation
  UNION ALL SELECT DISTINCT {PATH}, 'z', NULL, 0 FROM nation""",
)
def jon13(t: Tables) -> DataFrame:
    """Ours changes ranks, theirs adds an element: the merged documents' elements."""
    from lamina.operators.xmldiff import merge_documents

    f = changed_files(t)
    merged = merge_documents(f.select("path", "a", F.col("b").alias("o"), F.regexp_replace("a", "</atlas>", '<extra id="z"/></atlas>').alias("t")))
    n = X.shred(merged.select("path", F.col("xml").alias("content"))).where("id is not null")
    rank = F.get(F.filter("attrs", lambda a: a["local_name"] == "rank"), 0)["value"].alias("rank")
    return n.select("path", "id", rank).join(merged.select("path", F.size("conflicts").alias("conflicts")), "path")


def spec_files(t: Tables) -> DataFrame:
    """A spec: an index that lists a file per region (and one that is missing), sections that reference nations, mappings with ranges."""
    section = F.concat(F.lit('<p:section id="n'), F.col("n_nationkey").cast("string"), F.lit('"><t:ref term="r'), F.col("n_regionkey").cast("string"), F.lit('"/></p:section><r:relation type="refines" from="n'), F.col("n_nationkey").cast("string"), F.lit('" to="x'), (F.col("n_nationkey") % 4).cast("string"), F.lit('"/><m:mapping id="m'), F.col("n_nationkey").cast("string"), F.lit('"><m:spec-ref node="n'), F.col("n_nationkey").cast("string"), F.lit('" node-hash="sha256:1"/><m:artifact path="a.py"><m:range start-line="'), F.col("n_nationkey").cast("string"), F.lit('" end-line="30"/></m:artifact></m:mapping>'))
    head = '<s:spec xmlns:s="urn:s" xmlns:i="urn:i" xmlns:p="urn:p" xmlns:t="urn:t" xmlns:r="urn:r" xmlns:m="urn:m">'
    per = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", section.alias("x")))).alias("a"))
    files = per.select(F.concat(F.lit("spec/r"), F.col("n_regionkey").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit(head), F.array_join(F.transform("a", lambda s: s["x"]), ""), F.lit("</s:spec>")).alias("content"))
    entry = F.concat(F.lit('<i:file href="./r'), F.col("r_regionkey").cast("string"), F.lit('.xml"/>'))
    index = t.region.agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("e")).select(F.lit("spec/index.xml").alias("path"), F.concat(F.lit(head), "e", F.lit('<i:file href="missing.xml"/></s:spec>')).alias("content"))
    return files.unionByName(index)


def spec_nodes(t: Tables) -> DataFrame:
    return X.shred(spec_files(t), hashes=False)


@query("src3_spec_files", "SELECT 'spec/r' || r_regionkey || '.xml' AS path FROM region UNION ALL SELECT 'spec/index.xml'")
def src3(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    n = spec_nodes(t)
    return S.spec_files(n, S.index_files(n, "urn:s", "urn:i"), "urn:i").select("path")


@query("src2_index_files", "SELECT 'spec/index.xml' AS path")
def src2(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.index_files(spec_nodes(t), "urn:s", "urn:i")


@query("src11_mappings", "SELECT 'm' || n_nationkey AS id, 'n' || n_nationkey AS node, 'a.py' AS artifact_path, 'sha256:1' AS node_hash, n_nationkey || '-30' AS lines FROM nation")
def src11(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.listing(S.mappings(spec_nodes(t), "urn:m"))


@query("prj14_mapping_ranges", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS starts FROM nation")
def prj14(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.mappings(spec_nodes(t), "urn:m").select(F.explode("ranges").alias("r")).agg(F.count("*").alias("n"), F.sum("r.start_line").alias("starts"))


@query("jon20_synthesised_relations", "SELECT 'term' AS type, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation")
def jon20(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.synthesised(spec_nodes(t), {"term": ("urn:t", "ref", "term")})


@query("set7_union_of_rules", "SELECT type, count(*) AS n FROM (SELECT 'term' AS type FROM nation UNION ALL SELECT 'map' FROM nation) GROUP BY type")
def set7(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.synthesised(spec_nodes(t), {"term": ("urn:t", "ref", "term"), "map": ("urn:m", "spec-ref", "node")}).groupBy("type").agg(F.count("*").alias("n"))


@query("val5_validate", "SELECT 'reference' AS rule, 'x' || k AS detail FROM (SELECT DISTINCT n_nationkey % 4 AS k FROM nation)")
def val5(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    n = spec_nodes(t)
    return S.validate(n, S.relations(n, "urn:r"), S.index_files(n, "urn:s", "urn:i")).select("rule", "detail")


@query("val4_rule_subset", "SELECT count(*) AS n FROM nation WHERE n_nationkey % 4 <> 0")
def val4(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    return S.rule_violations(spec_nodes(t), "urn:r", {"relation": ["type"]}, {("relation", "to"): ["x0"]}, {("relation", "from"): "n[0-9]+"}).agg(F.count("*").alias("n"))


@query("drf2_first_existing_path", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'root/' || n_nationkey ELSE 'spec/' || n_nationkey END AS path FROM nation")
def drf2(t: Tables) -> DataFrame:
    from lamina.sources import specs as S

    k = F.col("n_nationkey").cast("string")
    options = t.nation.select(F.col("n_nationkey").alias("id"), F.posexplode(F.array(F.concat(F.lit("root/"), k), F.concat(F.lit("up/"), k), F.concat(F.lit("spec/"), k))).alias("ord", "path"))
    known = options.where("path like 'spec/%' or (path like 'root/%' and id % 2 = 0)")
    return S.first_existing(options, known)

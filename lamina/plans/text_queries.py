"""Line, coverage, drift, validation, hash, text and search queries over documents, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import hashing as H
from lamina.functions import text as T
from lamina.operators import coverage as C
from lamina.operators import reports as P
from lamina.operators import search as S
from lamina.operators import versions as V
from lamina.plans.registry import Tables, query

TWICE = "'sha256:' || sha256(unhex(sha256({x})))"


@query("src14_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def src14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.line_range(F.col("text"), 2, 4).alias("part"))


@query("fn1_hashes", f"SELECT doc_id, 'sha256:' || sha256(text) AS leaf, {TWICE.format(x='text')} AS file, true AS valid FROM documents")
def fn1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", H.text_hash(F.col("text")).alias("leaf"), H.file_hash(F.col("text")).alias("file"), H.is_valid(H.text_hash(F.col("text"))).alias("valid"))


@query(
    "fn3_name_hash32",
    """SELECT n_name, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(substr(n_name, i, 1)) AS HUGEINT))),
    lambda h, b: (xor((h * 32) % 4294967296 + h // 134217728, b) * 2654435769) % 4294967296)::BIGINT AS h FROM nation""",
)
def fn3(t: Tables) -> DataFrame:
    return t.nation.select("n_name", H.name_hash32(F.col("n_name")).alias("h"))


@query("fn9_preview", "SELECT doc_id, CASE WHEN length(p) > 60 THEN substr(p, 1, 60) || '…' ELSE p END AS preview FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^[^\\n]*\\n?', ''), '\\s+', ' ', 'g')) AS p FROM documents)")
def fn9(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.preview(F.col("text"), 60).alias("preview"))


@query("fn10_truncate", "SELECT doc_id, CASE WHEN length(text) > 350 THEN substr(text, 1, 350) || '…' ELSE text END AS peek FROM documents")
def fn10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncated(F.col("text"), 350).alias("peek"))


@query("fn11_chunk_text", "SELECT doc_id, '[layer=' || lang || ' path=' || source || '>' || lang || ']' || chr(10) || trim(text, ' ') AS chunk FROM documents")
def fn11(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.chunk_text(F.col("lang"), F.array("source", "lang"), F.col("text")).alias("chunk"))


@query("fn12_layer_of", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'urn:other:' || lang END AS layer FROM documents")
def fn12(t: Tables) -> DataFrame:
    ns = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(T.URN), "lang")).otherwise(F.concat(F.lit("urn:other:"), "lang"))
    return t.documents.select("doc_id", T.layer_of(ns).alias("layer"))


@query("fn14_filled_lines", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS INT) AS n FROM documents")
def fn14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.filled_lines(F.col("text")).alias("n"))


@query("fn15_strength", "SELECT p_partkey, CASE WHEN p_size * 3 <= 30 THEN 'precise' WHEN p_size * 3 <= 100 THEN 'moderate' ELSE 'broad' END AS strength FROM part")
def fn15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.strength(F.col("p_size") * 3).alias("strength"))


@query("fn16_edge_score", "SELECT e, CASE e WHEN 'implements' THEN 106 WHEN 'refines' THEN 104 WHEN 'references' THEN 101 ELSE 100 END AS score FROM (SELECT unnest(['implements', 'refines', 'references', 'other']) AS e)")
def fn16(t: Tables) -> DataFrame:
    e = t.region.limit(1).select(F.explode(F.array(*[F.lit(x) for x in ("implements", "refines", "references", "other")])).alias("e"))
    return e.select("e", T.edge_score(F.lit("relation"), F.col("e")).alias("score"))


@query("fn17_peek", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), CASE WHEN doc_id % 2 = 0 THEN source END, '(no peek available)') AS peek FROM documents")
def fn17(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.peek(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("peek"))


@query("fn19_leaf_hash", "SELECT n_nationkey, 'sha256:' || sha256(unhex(hex('layered-repo:leaf:v1') || '00' || hex('comment') || '00' || lpad(hex(length(n_name)), 16, '0') || hex(n_name))) AS h FROM nation")
def fn19(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", H.leaf_hash("comment", F.col("n_name")).alias("h"))


@query("fn20_ref_names", "SELECT n_name, 'refs/heads/' || n_name AS branch, 'refs/tags/' || n_name AS tag FROM nation")
def fn20(t: Tables) -> DataFrame:
    return t.nation.select("n_name", T.branch_ref(F.col("n_name")).alias("branch"), T.tag_ref(F.col("n_name")).alias("tag"))


@query("fn21_xml_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def fn21(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.xml_escaped(F.col("html"), attribute=True).alias("escaped"))


@query("fn21_language", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' END AS language FROM documents")
def fn21_language(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.concat("source", F.when(k == 0, ".PY").when(k == 1, ".rs").otherwise(""))
    return t.documents.select("doc_id", T.language_of(path).alias("language"))


@query("fn22_extract_scores", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS score FROM events")
def fn22(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.number_after(F.col("props"), "k").alias("score"))


@query("fn23_context_size", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) + coalesce(l_tax, 0) + coalesce(l_discount, 0) AS size FROM lineitem")
def fn23(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", T.total_size(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")).alias("size"))


@query("fn24_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn24(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn25_timestamp_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def fn25(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.timestamp_text(F.col("ts")).alias("at"))


@query("snk7_json_rows", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def snk7(t: Tables) -> DataFrame:
    return V.json_rows(t.region, ["r_regionkey", "r_name"])


@query("win7_path_shingles", "SELECT doc_id, [source || '/' || lang || '/x', source, lang, 'x'] AS shingles FROM documents")
def win7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.path_shingles(F.array("source", "lang", F.lit("x"))).alias("shingles"))


@query("prj4_file_filter", "SELECT source, count(*) AS n FROM documents WHERE source LIKE '%1%' OR source LIKE '%rc7%' GROUP BY source")
def prj4(t: Tables) -> DataFrame:
    return t.documents.where(T.matches_any(F.col("source"), "1", "rc7")).groupBy("source").agg(F.count("*").alias("n"))


@query("prj5_aggregate_results", "SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def prj5(t: Tables) -> DataFrame:
    return P.joined_results(t.conversations, "conv_id", "turn", "text")


@query("prj7_side_paths", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-')")
def prj7(t: Tables) -> DataFrame:
    return t.orders.where(V.has_prefix(F.col("o_orderpriority"), "1-")).select("o_orderkey")


LAYERED = "CASE p_partkey % 4 WHEN 0 THEN 'prose' WHEN 1 THEN 'pr' WHEN 2 THEN 'trm' ELSE 'plan' END"


@query("prj8_layer_filter", f"SELECT p_partkey FROM part WHERE {LAYERED} IN ('pr', 'prose')")
def prj8(t: Tables) -> DataFrame:
    return t.part.where(T.in_layer(F.expr(LAYERED), "pr")).select("p_partkey")


HASHED = "CASE o_orderkey % 3 WHEN 0 THEN 'sha256:placeholder' WHEN 1 THEN 'sha256:' || {sha} ELSE 'none' END"


@query("prj9_eligible_hashes", f"SELECT o_orderkey FROM orders WHERE starts_with({HASHED.format(sha='sha256(o_orderstatus)')}, 'sha256:') AND {HASHED.format(sha='sha256(o_orderstatus)')} <> 'sha256:placeholder'")
def prj9(t: Tables) -> DataFrame:
    return t.orders.withColumn("h", F.expr(HASHED.format(sha="sha2(o_orderstatus, 256)"))).where(H.is_eligible(F.col("h"))).select("o_orderkey")


@query("prj10_exempt_references", "SELECT p_partkey FROM part WHERE NOT starts_with(CASE WHEN p_partkey % 5 = 0 THEN 'type-x' ELSE p_brand END, 'type-')")
def prj10(t: Tables) -> DataFrame:
    return t.part.where(~T.is_exempt(F.when(F.col("p_partkey") % 5 == 0, "type-x").otherwise(F.col("p_brand")))).select("p_partkey")


@query("prj11_path_filter", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
def prj11(t: Tables) -> DataFrame:
    return t.part.where(T.matches_any(F.col("p_name"), "a")).select("p_partkey")


@query("agg4_node_coverage", "SELECT (SELECT count(*) FROM customer) AS total, count(DISTINCT o_custkey) AS mapped, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS exempt, (SELECT count(*) FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS unmapped FROM orders WHERE o_orderkey % 3 = 0")
def agg4(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_custkey").alias("id"))
    return C.node_coverage(n, t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")), n.where("id % 9 = 0"))


@query("set2_unmapped", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def set2(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_custkey").alias("id"))
    return C.unmapped(n, t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")), n.where("id % 9 = 0"))


@query("agg5_mapping_lines", "SELECT l_orderkey AS id, CAST(sum(greatest(l_quantity - l_linenumber, 0) + 1) AS BIGINT) AS line_count, CASE WHEN sum(greatest(l_quantity - l_linenumber, 0) + 1) <= 30 THEN 'precise' WHEN sum(greatest(l_quantity - l_linenumber, 0) + 1) <= 100 THEN 'moderate' ELSE 'broad' END AS strength FROM lineitem GROUP BY l_orderkey")
def agg5(t: Tables) -> DataFrame:
    return C.mapping_lines(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").alias("end_line")))


LINES = """lines AS (SELECT doc_id AS path, i AS line, trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '' AS filled, (i >= doc_id % 3 + 1 AND i <= doc_id % 3 + 2) OR doc_id % 5 = 0 AS covered
  FROM (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS ls FROM documents)))"""


def covered(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    k = F.col("path") % 3
    ranges = files.select("path", F.when(F.col("path") % 5 != 0, k + 1).alias("start_line"), F.when(F.col("path") % 5 != 0, k + 2).alias("end_line"))
    return C.covered_lines(files, ranges)


@query("agg6_file_coverage", f"WITH {LINES} SELECT path, count(*) FILTER (filled) AS n_filled, count(*) FILTER (filled AND covered) AS n_covered, CASE WHEN count(*) FILTER (filled) > 0 THEN 100.0 * count(*) FILTER (filled AND covered) / count(*) FILTER (filled) ELSE 100.0 END AS percent FROM lines GROUP BY path")
def agg6(t: Tables) -> DataFrame:
    return C.file_coverage(covered(t))


@query("win3_uncovered_runs", f"WITH {LINES} SELECT path, min(line) AS first, max(line) AS last FROM (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM lines WHERE filled AND NOT covered) GROUP BY path, g")
def win3(t: Tables) -> DataFrame:
    return C.uncovered_runs(covered(t))


@query("jon18_range_join", f"WITH {LINES} SELECT path, line FROM lines WHERE covered")
def jon18(t: Tables) -> DataFrame:
    return covered(t).where("covered").select("path", "line")


DRIFT = """m AS (SELECT p_partkey AS id, 'sha256:' || sha256(CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE p_name END) AS node_hash FROM part),
r AS (SELECT p_partkey AS id, p_partkey % 100 AS path, 'sha256:' || sha256(CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_partkey % 100 AS VARCHAR) END) AS hash FROM part),
s AS (SELECT p.p_partkey AS id, CASE WHEN m.node_hash <> 'sha256:' || sha256(p_name) THEN 'spec-drifted' WHEN r.path >= 90 THEN 'unavailable' WHEN r.hash <> 'sha256:' || sha256(CAST(r.path AS VARCHAR)) THEN 'artifact-drifted' ELSE 'clean' END AS status
  FROM part p JOIN m ON m.id = p.p_partkey JOIN r ON r.id = p.p_partkey)"""


def drifted(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    m = p.select("id", F.col("id").alias("node"), H.text_hash(F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("p_name"))).alias("node_hash"))
    path = F.col("id") % 100
    r = p.select("id", F.lit(0).alias("ord"), path.alias("path"), H.text_hash(F.when(F.col("id") % 5 == 0, "x").otherwise(path.cast("string"))).alias("hash"))
    files = t.spark.range(90).select(F.col("id").alias("path"), H.text_hash(F.col("id").cast("string")).alias("hash"))
    return C.drift(m, p.select(F.col("id").alias("node"), H.text_hash(F.col("p_name")).alias("hash")), r, files)


@query("drf1_drift", f"WITH {DRIFT} SELECT id, status FROM s")
def drf1(t: Tables) -> DataFrame:
    return drifted(t)


@query("jon4_node_hash_join", f"WITH {DRIFT} SELECT m.id, m.node_hash, CASE WHEN p_partkey % 4 <> 0 THEN 'sha256:' || sha256(p_name) END AS now FROM m JOIN part ON p_partkey = m.id")
def jon4(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    m = p.select("id", F.col("id").alias("node"), H.text_hash(F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("p_name"))).alias("node_hash"))
    return C.with_current(m, p.where("id % 4 <> 0").select(F.col("id").alias("node"), H.text_hash(F.col("p_name")).alias("hash"))).select("id", "node_hash", "now")


@query("agg7_drift_summary", f"WITH {DRIFT} SELECT count(*) AS total, count(*) FILTER (status IN ('spec-drifted', 'artifact-drifted')) AS drifted FROM s")
def agg7(t: Tables) -> DataFrame:
    return C.drift_summary(drifted(t))


@query("snk5_fix_hashes", "SELECT p_partkey AS id, 'sha256:' || sha256('old') AS old, 'sha256:' || sha256(p_name) AS new FROM part WHERE p_partkey % 7 = 0")
def snk5(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    return C.fixed_hashes(p.select("id", H.text_hash(F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("p_name"))).alias("hash")), p.select("id", H.text_hash(F.col("p_name")).alias("hash")))


@query("drf3_first_node", "SELECT conv_id AS id, min(turn) AS pre, 'sha256:' || sha256(arg_min(text, turn)) AS hash FROM conversations GROUP BY conv_id")
def drf3(t: Tables) -> DataFrame:
    return P.first_nodes(t.conversations.withColumnRenamed("conv_id", "id"), "id", "turn", "text").select("id", "pre", H.text_hash(F.col("text")).alias("hash"))


DUPES = "WITH d AS (SELECT sha256(text) AS id, doc_id AS path FROM documents), f AS (SELECT id, min(path) AS first_path FROM d GROUP BY id HAVING count(*) > 1) SELECT d.id, d.path, f.first_path FROM d JOIN f USING (id) WHERE d.path <> f.first_path"

@query("agg21_duplicate_ids", DUPES)
def agg21(t: Tables) -> DataFrame:
    return C.duplicate_ids(t.documents.select(F.sha2("text", 256).alias("id"), F.col("doc_id").alias("path"), F.col("doc_id").alias("ord")))


@query("jon22_keyrefs", "SELECT 'order-customer' AS rule, CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY o_custkey UNION ALL SELECT 'line-part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 1) GROUP BY l_partkey")
def jon22(t: Tables) -> DataFrame:
    return C.check_keyrefs({"order-customer": (t.orders, "o_custkey", t.customer.where("c_custkey % 3 <> 0"), "c_custkey"), "line-part": (t.lineitem, "l_partkey", t.part.where("p_partkey % 4 <> 1"), "p_partkey")})


@query("jon5_chunk_spans", "SELECT o_custkey AS id, arg_max(o_orderpriority, (o_orderpriority, -o_orderkey)) AS file, arg_max(o_orderkey, (o_orderpriority, -o_orderkey)) AS pre, c_mktsegment AS layer FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_mktsegment")
def jon5(t: Tables) -> DataFrame:
    """Orders are spans of customers' chunks, their priority the file: the last file's first span counts."""
    spans = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("pre"))
    return P.last_spans(spans, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer")))


@query(
    "jon6_relation_lists",
    """WITH e AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, o_orderpriority AS type FROM orders), o AS (SELECT src, list_sort(list(DISTINCT type)) AS l FROM e GROUP BY src), i AS (SELECT dst, list_sort(list(DISTINCT type)) AS l FROM e GROUP BY dst)
  SELECT c_custkey AS id, coalesce(o.l, []) AS outgoing, coalesce(i.l, []) AS incoming FROM customer LEFT JOIN o ON src = c_custkey LEFT JOIN i ON dst = c_custkey""",
)
def jon6(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderpriority").alias("type"))
    return P.relation_lists(t.customer.select(F.col("c_custkey").alias("id")), edges)


Q = "(SELECT embedding FROM embeddings WHERE vec_id = {k})"
COS = "round(CASE WHEN sqrt(list_sum(list_transform({e}, lambda x: CAST(x AS DOUBLE) * x))) < 1e-12 THEN 0 ELSE list_cosine_similarity(CAST({e} AS DOUBLE[]), CAST({q} AS DOUBLE[])) END, 6)"


def index(t: Tables) -> DataFrame:
    words = F.array(*[F.col("label").cast("long") * 7 + i for i in range(4)])
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", words.alias("bits"), "label")


def asked(t: Tables, *ids: int) -> DataFrame:
    return index(t).where(F.col("id").isin(*ids)).select(F.col("id").alias("query_id"), F.col("embedding").alias("q_embedding"), F.col("bits").alias("q_bits"))


@query("fn5_cosine", f"SELECT vec_id AS id, {COS.format(e='embedding', q=Q.format(k=0))} AS cos FROM embeddings")
def fn5(t: Tables) -> DataFrame:
    return index(t).crossJoin(F.broadcast(asked(t, 0))).select("id", F.round(S.cosine(F.col("embedding"), F.col("q_embedding")), 6).alias("cos"))


@query("fn6_tanimoto", "WITH b AS (SELECT label FROM embeddings WHERE vec_id = 0), x AS (SELECT a.vec_id AS id, sum(bit_count((CAST(a.label AS BIGINT) * 7 + i) & (CAST(b.label AS BIGINT) * 7 + i))) AS n, sum(bit_count((CAST(a.label AS BIGINT) * 7 + i) | (CAST(b.label AS BIGINT) * 7 + i))) AS d FROM embeddings a, b, range(4) r(i) GROUP BY a.vec_id) SELECT id, round(CASE WHEN d = 0 THEN 1 ELSE n / d END, 6) AS tan FROM x")
def fn6(t: Tables) -> DataFrame:
    return index(t).crossJoin(F.broadcast(asked(t, 0))).select("id", F.round(S.tanimoto(F.col("bits"), F.col("q_bits")), 6).alias("tan"))


HITS = f"""hits AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {COS.format(e='a.embedding', q='q.embedding')} AS cos FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN (0, 7)) q),
scored AS (SELECT query_id, id, round(0.7 * cos, 8) AS score FROM hits), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


@query("top4_search", f"WITH {HITS} SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10")
def top4(t: Tables) -> DataFrame:
    return S.top_k(index(t), asked(t, 0, 7)).select("query_id", "id", "score", "rank")


# The structural part of all pairs with the queries.
TAN = """tan AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(CASE WHEN sum(bit_count((CAST(a.label AS BIGINT) * 7 + i) | (CAST(q.label AS BIGINT) * 7 + i))) = 0 THEN 1
  ELSE sum(bit_count((CAST(a.label AS BIGINT) * 7 + i) & (CAST(q.label AS BIGINT) * 7 + i))) / sum(bit_count((CAST(a.label AS BIGINT) * 7 + i) | (CAST(q.label AS BIGINT) * 7 + i))) END, 6) AS tan
  FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN (0, 7)) q, range(4) r(i) GROUP BY q.vec_id, a.vec_id)"""


@query(
    "sea4_exact_scan",
    f"WITH {HITS}, {TAN}, d AS (SELECT query_id, id, round(0.7 * (1 - cos) + 0.3 * (1 - tan), 8) AS dist FROM hits JOIN tan USING (query_id, id)) SELECT query_id, id, dist FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 10",
)
def sea4(t: Tables) -> DataFrame:
    """By the index's own metric, which always counts the structural part."""
    return S.nearest(index(t), asked(t, 0, 7)).select("query_id", "id", "dist")


@query(
    "sea5_search",
    f"""WITH {HITS}, {TAN}, s AS (SELECT query_id, id, round(0.7 * cos + 0.3 * tan, 8) AS score FROM hits JOIN tan USING (query_id, id) JOIN embeddings ON vec_id = id WHERE label % 3 = 1 AND id % 2 = 0)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
)
def sea5(t: Tables) -> DataFrame:
    """A search in one layer, among the ids that a path selects."""
    i = index(t)
    found = S.filtered_search(i.withColumn("layer", (F.col("label") % 3).cast("string")), asked(t, 0, 7), layer="1", allowed=i.where("id % 2 = 0").select("id"))
    return found.select("query_id", "id", "score", "rank")


@query("agg11_best_of_queries", f"WITH {HITS} SELECT id, max(score) AS score FROM ranked WHERE rank <= 10 GROUP BY id ORDER BY score DESC, id LIMIT 10")
def agg11(t: Tables) -> DataFrame:
    return S.best_of(S.top_k(index(t), asked(t, 0, 7)))


@query("sea6_multi_query", f"WITH {HITS} SELECT id, max(score) AS score, list_sort(list(query_id)) AS found_by FROM ranked WHERE rank <= 10 GROUP BY id")
def sea6(t: Tables) -> DataFrame:
    """Several queries at once: each hit with its best score and the queries that found it."""
    hits = S.top_k(index(t), asked(t, 0, 7))
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("query_id")).alias("found_by"))


@query("set5_union_of_hits", f"WITH {HITS} SELECT id FROM ranked WHERE rank <= 10 AND query_id = 0 UNION SELECT id FROM ranked WHERE rank <= 10 AND query_id = 7")
def set5(t: Tables) -> DataFrame:
    first, second = (S.top_k(index(t), asked(t, k)).select("id") for k in (0, 7))
    return first.union(second).distinct()


@query("jon17_filtered_hits", f"WITH {HITS} SELECT r.id, r.score, e.label FROM ranked r JOIN embeddings e ON e.vec_id = r.id WHERE rank <= 10 AND query_id = 0 AND r.id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def jon17(t: Tables) -> DataFrame:
    hits = S.top_k(index(t), asked(t, 0)).join(index(t).select("id", "label"), "id")
    return hits.join(index(t).where("id % 2 = 0").select("id"), "id", "left_semi").select("id", "score", "label")


@query("set3_allowed_ids", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE label % 2 = 1")
def set3(t: Tables) -> DataFrame:
    i = index(t)
    return i.where("id % 2 = 0").select("id").intersect(i.where("label % 2 = 1").select("id"))


@query("fn7_distance", f"SELECT vec_id AS id, round(0.7 * (1 - {COS.format(e='embedding', q=Q.format(k=0))}) + 0.3 * 0.5, 8) AS dist FROM embeddings")
def fn7(t: Tables) -> DataFrame:
    cos = F.round(S.cosine(F.col("embedding"), F.col("q_embedding")), 6)
    return index(t).crossJoin(F.broadcast(asked(t, 0))).select("id", F.round(S.distance(cos, F.lit(0.5)), 8).alias("dist"))


HASH32 = """list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, i, 1)) AS HUGEINT))),
    lambda h, b: (xor((h * 32) % 4294967296 + h // 134217728, b) * 2654435769) % 4294967296)::BIGINT"""
BITS = f"""k AS (SELECT DISTINCT source, lang FROM documents),
p AS (SELECT source, lang, list_distinct([1, 11 + {HASH32.format(x='source')} % 32, 43 + {HASH32.format(x="(source || '/' || lang)")} % 128, 43 + {HASH32.format(x='source')} % 128,
  43 + {HASH32.format(x='lang')} % 128, 171 + {HASH32.format(x='lang')} % 16, 187 + {HASH32.format(x="'refines'")} % 32]) AS bits FROM k),
w AS (SELECT source, lang, [list_sum(list_transform(list_filter(bits, lambda b: b // 64 = j), lambda b: CAST(1 AS HUGEINT) << CAST(b % 64 AS INT))) FOR j IN [0, 1, 2, 3]] AS words FROM p)"""


@query("fn4_fingerprint", f"WITH {BITS} SELECT doc_id, list_transform(words, lambda x: CAST(CASE WHEN coalesce(x, 0) >= 9223372036854775808 THEN x - 18446744073709551616 ELSE coalesce(x, 0) END AS BIGINT)) AS bits FROM documents JOIN w USING (source, lang)")
def fn4(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    return t.documents.select("doc_id", S.fingerprint(F.lit("prose"), F.col("source"), F.array("source", "lang"), F.col("lang"), F.array(F.lit("refines")), none).alias("bits"))


# Reports over events as runs.
@query("agg13_mean_and_deviation", "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev FROM events GROUP BY event_type")
def agg13(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"))


@query("agg14_run_summary", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value) FILTER (user_id % 10 <> 0), 6) AS mean, max(value) FILTER (user_id % 10 <> 0) AS most, count(*) FILTER (user_id % 10 = 0) AS errors, count(*) FILTER (event_id % 3 = 0) AS won_a, count(*) FILTER (event_id % 3 = 1) AS won_b FROM events GROUP BY event_type")
def agg14(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    runs = t.events.withColumn("verdict", F.when(k == 0, "a").when(k == 1, "b").otherwise("tie"))
    return P.run_summary(runs, "event_type", "value", F.col("user_id") % 10 == 0, "verdict", ("a", "b"))


@query("agg15_phase_costs", "SELECT user_id, round(sum(value) FILTER (starts_with(event_type, 'c')), 4) AS phase_c, round(CASE WHEN sum(value) = 0 THEN 0 ELSE count(*) / (sum(value) / 60000) END, 4) AS per_minute FROM events GROUP BY user_id")
def agg15(t: Tables) -> DataFrame:
    return P.phase_costs(t.events, "user_id", "event_type", "value", ("c",))


@query("agg16_line_metrics", "SELECT n_regionkey, count(*) * 2 AS added, count(*) AS removed, count(DISTINCT n_nationkey) AS files, count(*) AS tests FROM nation GROUP BY n_regionkey")
def agg16(t: Tables) -> DataFrame:
    """A unified diff per nation: one line goes, two come, one of which declares a test."""
    f = F.concat(F.col("n_nationkey").cast("string"), F.lit(".py"))
    diff = F.concat(F.lit("--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +1,2 @@\n-"), "n_name", F.lit("\n+"), F.lower("n_name"), F.lit("\n+def test_"), F.lower("n_name"), F.lit("():\n same"))
    return P.diff_metrics(t.nation.select("n_regionkey", diff.alias("diff")), "n_regionkey")


@query("agg23_arm_summary", "SELECT event_type AS arm, round(coalesce(avg(value), 0), 2) AS mean, round(avg(value) - (SELECT avg(value) FROM events WHERE event_type = 'click'), 2) AS delta FROM events GROUP BY event_type")
def agg23(t: Tables) -> DataFrame:
    return P.arm_summary(t.events, "event_type", "value", "click")


@query("str1_ref_updates", "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events")
def str1(t: Tables) -> DataFrame:
    from lamina.streaming.refs import updates

    return updates(t.events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "old", "new")


@query("str4_bursts", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)) GROUP BY user_id, s")
def str4(t: Tables) -> DataFrame:
    from lamina.streaming.refs import bursts

    return bursts(t.events, "user_id", "ts", "3600 seconds")

"""Object store, schema, catalog, sync policy, subscription and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import repository as R
from lamina.operators import search as S
from lamina.operators import versions as V
from lamina.operators.tables import fresh_path
from lamina.plans.registry import Tables, query
from lamina.plans.version_queries import COMMITS, commits
from lamina.sources import specs, store
from lamina.sources import xml as X


def object_rows(t: Tables) -> DataFrame:
    """Documents as objects; the inclusive hash is that of the language."""
    return t.documents.select(F.sha2("text", 256).alias("hash"), F.sha2("lang", 256).alias("inclusive_hash"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("kind"), F.substring("text", 1, 40).alias("body")).dropDuplicates(["hash"])


HELD = """SELECT hash, hash IN (SELECT sha256(text) FROM documents) AS held FROM (SELECT DISTINCT sha256(text) AS hash FROM benchmark UNION SELECT min(sha256(text)) FROM documents UNION SELECT max(sha256(text)) FROM documents)"""


def wanted_hashes(t: Tables) -> DataFrame:
    ends = t.documents.agg(F.min(F.sha2("text", 256)).alias("a"), F.max(F.sha2("text", 256)).alias("b"))
    return t.benchmark.select(F.sha2("text", 256).alias("hash")).union(ends.select(F.explode(F.array("a", "b"))))


@query("src7_object_lookup", HELD)
def src7(t: Tables) -> DataFrame:
    s = store.ObjectStore(t.spark, fresh_path(t.spark, "store"))
    s.put(object_rows(t))
    return s.contains(wanted_hashes(t))


@query("src7_inclusive_lookup", "SELECT sha256(lang) AS inclusive_hash, min(sha256(text)) AS hash FROM documents GROUP BY 1 ORDER BY 1 LIMIT 1")
def src7_inclusive(t: Tables) -> DataFrame:
    s = store.ObjectStore(t.spark, fresh_path(t.spark, "store"))
    s.put(object_rows(t))
    first = t.documents.agg(F.min(F.sha2("lang", 256))).first()[0]
    return s.by_inclusive_hash(first).select("inclusive_hash", "hash")


@query("src8_memory_store", HELD)
def src8(t: Tables) -> DataFrame:
    s = store.MemoryStore(t.spark)
    s.put(object_rows(t).where("kind <> 'k2'"))
    s.put(object_rows(t))
    return s.contains(wanted_hashes(t))


@query("src9_remote_store", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def src9(t: Tables) -> DataFrame:
    """A store that another one fetches from; what it holds already is not sent again."""
    there, here = (fresh_path(t.spark, "store") for _ in range(2))
    store.ObjectStore(t.spark, there).put(object_rows(t))
    own = store.ObjectStore(t.spark, here)
    own.put(object_rows(t).where("kind = 'k0'"))
    store.RemoteStore(t.spark, there).fetch(own)
    return own.objects().select("hash")


@query("str2_subtree", "SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS hash FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
def str2(t: Tables) -> DataFrame:
    """What a remote store answers to a request for subtrees: every object below each root."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    region, nation = name("r", "r_regionkey"), name("n", "n_nationkey")
    s = store.MemoryStore(t.spark)
    row = lambda h: (h.alias("hash"), h.alias("inclusive_hash"), F.lit("element").alias("kind"), h.alias("body"))
    s.put(t.region.select(*row(region)).unionByName(t.nation.select(*row(nation))))
    return s.subtree(t.region.select(region.alias("hash")), t.nation.select(name("r", "n_regionkey").alias("parent"), nation.alias("child"))).select("root", "hash")


@query("snk4_export_tree", "SELECT conv_id AS path, d.text AS xml FROM conversations JOIN documents d ON d.doc_id = conv_id WHERE turn = 0")
def snk4(t: Tables) -> DataFrame:
    entries = t.conversations.where("turn = 0").select(F.col("conv_id").alias("path"), F.col("conv_id").alias("document"))
    return store.export_tree(entries, t.documents.select(F.col("doc_id").alias("document"), F.col("text").alias("xml")))


@query(
    "grf6_dag_diff",
    """WITH a AS (SELECT l_orderkey AS parent, l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'text' ELSE 'element' END AS kind, l_partkey AS hash FROM lineitem),
  b AS (SELECT parent, ord, CASE WHEN hash % 6 = 1 THEN 'comment' ELSE kind END AS kind, CASE WHEN hash % 3 = 1 THEN -hash ELSE hash END AS hash FROM a WHERE hash % 10 <> 9)
  SELECT a.parent, a.ord, unnest(CASE WHEN b.hash IS NULL THEN ['removed'] WHEN a.kind <> b.kind THEN ['removed', 'added'] WHEN a.kind = 'text' THEN ['text-changed'] ELSE ['changed'] END) AS change FROM a LEFT JOIN b ON a.parent = b.parent AND a.ord = b.ord WHERE a.hash IS DISTINCT FROM b.hash""",
)
def grf6(t: Tables) -> DataFrame:
    h = F.col("hash")
    a = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "text").otherwise("element").alias("kind"), F.col("l_partkey").alias("hash"))
    b = a.where(h % 10 != 9).select("parent", "ord", F.when(h % 6 == 1, "comment").otherwise(F.col("kind")).alias("kind"), F.when(h % 3 == 1, -h).otherwise(h).alias("hash"))
    return store.dag_diff(a, b)


for _policy, _moved in (("overwrite", "fast-forward"), ("reject", "rejected")):

    @query(
        f"grf11_policy_{_policy}",
        f"""WITH {COMMITS}, tips AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING max(turn) > 0)
  SELECT 'b' || conv_id AS name, 'k' || conv_id || '.0' AS old, 'k' || conv_id || '.' || turn AS new, '{_moved}' AS step FROM tips""",
    )
    def grf11(t: Tables, policy: str = _policy) -> DataFrame:
        c = commits(t)
        tips = c.groupBy("conv_id").agg(F.max_by("commit", "turn").alias("hash"), F.min_by("commit", "turn").alias("root"), F.max("turn").alias("n")).where("n > 0")
        name = F.concat(F.lit("b"), F.col("conv_id").cast("string")).alias("name")
        return V.sync_plan(tips.select(name, "hash"), tips.select(name, F.col("root").alias("hash")), c.where("parent is not null"), policy)


MOVES = f"""{COMMITS}, tips AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, 'refs/heads/b' || conv_id AS name, 'k' || conv_id || '.' || turn AS hash, turn FROM tips)"""


def moving(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads at each conversation's last turn, the same heads at the first one (every third is missing), and the history."""
    c = commits(t)
    tips = c.groupBy("conv_id").agg(F.max_by("commit", "turn").alias("hash"), F.min_by("commit", "turn").alias("root"))
    name = F.concat(F.lit("refs/heads/b"), F.col("conv_id").cast("string")).alias("name")
    return tips.select(name, "hash"), tips.where("conv_id % 3 <> 0").select(name, F.col("root").alias("hash")), c.where("parent is not null")


@query("wrk14_push", f"WITH {MOVES} SELECT name, CASE WHEN conv_id % 3 = 0 THEN 'create' WHEN turn = 0 THEN 'up-to-date' ELSE 'fast-forward' END AS step, hash FROM r")
def wrk14(t: Tables) -> DataFrame:
    source, target, history = moving(t)
    objects = source.select("hash")
    refs, plan, _ = R.push(source, target, history, objects, target.select("hash"))
    return refs.join(plan.select("name", "step"), "name").select("name", "step", "hash")


@query("wrk14_pull", f"WITH {MOVES} SELECT name, 'blocked' AS step, CASE WHEN conv_id % 3 <> 0 THEN 'k' || conv_id || '.0' END AS hash FROM r")
def wrk14_pull(t: Tables) -> DataFrame:
    """A working copy with a changed file: nothing moves."""
    remote, own, history = moving(t)
    tree = t.nation.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("hash"))
    disk = tree.withColumn("hash", F.when(F.col("path") == "NATION_2", "other").otherwise(F.col("hash")))
    none = t.spark.createDataFrame([], "path string, action string, hash string")
    refs, plan, _ = R.pull(own, remote, history, tree, disk, none, tree)
    return plan.select("name", "step").join(refs, "name", "left").select("name", "step", "hash")


@query("wrk14_pull_obstacles", "SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'modified' ELSE 'would be overwritten' END AS reason FROM nation WHERE n_nationkey % 5 IN (0, 1)")
def wrk14_obstacles(t: Tables) -> DataFrame:
    remote, own, history = moving(t)
    k = F.col("n_nationkey") % 5
    named = lambda df, h: df.select(F.col("n_name").alias("path"), h.alias("hash"))
    tracked = named(t.nation.where(k != 1), F.sha2("n_name", 256))
    disk = named(t.nation, F.when(k == 0, "changed").otherwise(F.sha2("n_name", 256)))
    none = t.spark.createDataFrame([], "path string, action string, hash string")
    incoming = named(t.nation.where(k <= 1), F.lit("incoming"))
    return R.pull(own, remote, history, tracked, disk, none, incoming)[2]


@query("wrk15_subscriptions", "SELECT DISTINCT e.user_id AS conn, e.event_type AS repo FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS off FROM events WHERE event_id % 7 = 0 GROUP BY user_id) o USING (user_id) WHERE e.event_id % 7 <> 0 AND (off IS NULL OR e.event_id > off)")
def wrk15(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 0, "disconnect").otherwise("read")
    return store.subscriptions(t.events.select(F.col("user_id").alias("conn"), F.col("event_type").alias("repo"), kind.alias("kind"), F.col("event_id").alias("at")))


@query(
    "str5_open_transactions",
    """WITH e AS (SELECT user_id AS conn, CASE event_id % 5 WHEN 0 THEN 'disconnect' WHEN 1 THEN 'commit' ELSE 'begin' END AS kind, event_id AS pos FROM events), o AS (SELECT conn, max(pos) AS off FROM e WHERE kind = 'disconnect' GROUP BY conn)
  SELECT conn, count(*) FILTER (kind = 'begin') - count(*) FILTER (kind = 'commit') AS n_open FROM e LEFT JOIN o USING (conn) WHERE off IS NULL OR pos > off GROUP BY conn HAVING count(*) FILTER (kind = 'begin') > count(*) FILTER (kind = 'commit')""",
)
def str5(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    return store.open_transactions(t.events.select(F.col("user_id").alias("conn"), F.when(k == 0, "disconnect").when(k == 1, "commit").otherwise("begin").alias("kind"), F.col("event_id").alias("at")))


XSD = "http://www.w3.org/2001/XMLSchema"


def schema_nodes(t: Tables) -> DataFrame:
    """A schema per region: an enumeration of its nations, some marked acyclic, and element declarations."""
    value = F.concat(F.lit('<xs:enumeration value="'), F.lower("n_name"), F.lit('"><xs:annotation><xs:appinfo>'), F.when(F.col("n_nationkey") % 3 == 0, '<r:acyclic value="true"/>').otherwise('<r:acyclic value="false"/>'), F.lit("</xs:appinfo></xs:annotation></xs:enumeration>"), F.lit('<xs:element name="e'), F.col("n_nationkey").cast("string"), F.lit('" type="xs:string" minOccurs="'), (F.col("n_nationkey") % 2).cast("string"), F.lit('" maxOccurs="'), F.when(F.col("n_nationkey") % 4 < 2, "unbounded").otherwise("1"), F.lit('"/>'))
    per = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", value.alias("x")))).alias("a"))
    body = F.concat(F.lit(f'<xs:schema xmlns:xs="{XSD}" xmlns:r="urn:r">'), F.array_join(F.transform("a", lambda s: s["x"]), ""), F.lit("</xs:schema>"))
    return X.shred(per.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".xsd")).alias("path"), body.alias("content")), hashes=False)


@query("sch1_acyclic_types", "SELECT lower(n_name) AS value FROM nation WHERE n_nationkey % 3 = 0")
def sch1(t: Tables) -> DataFrame:
    return specs.annotated_values(schema_nodes(t), XSD, "urn:r", "acyclic", "enumeration")


@query("snk9_schema_elements", "SELECT n_regionkey || '.xsd' AS path, 'e' || n_nationkey AS name, 'xs:string' AS type, CASE WHEN n_nationkey % 4 < 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE '+' END WHEN n_nationkey % 2 = 0 THEN '?' ELSE '' END AS quantifier FROM nation")
def snk9(t: Tables) -> DataFrame:
    return specs.schema_elements(schema_nodes(t), XSD)


@query("src12_catalog", "SELECT n_name AS name, 'f' || n_nationkey AS uri FROM nation WHERE n_nationkey % 5 <> 0")
def src12(t: Tables) -> DataFrame:
    one = F.concat(F.lit('<uri name="'), "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit('" uri="f'), F.col("n_nationkey").cast("string"))).otherwise(""), F.lit('"/>'))
    files = t.nation.groupBy(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("path")).agg(F.concat(F.lit("<catalog>"), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit("</catalog>")).alias("content"))
    return specs.catalog(X.shred(files, hashes=False))


@query("fn13_prefix_lookup", "SELECT k, CASE k % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'trm' END AS short FROM (SELECT n_nationkey AS k FROM nation)")
def fn13(t: Tables) -> DataFrame:
    layer = F.when(F.col("n_nationkey") % 3 == 0, "prose").when(F.col("n_nationkey") % 3 == 1, "terminology").otherwise("other")
    return t.nation.select(F.col("n_nationkey").alias("k"), T.short_layer(layer).alias("short"))


@query("fn26_remote_kind", "SELECT k, CASE WHEN u LIKE 'ws%' THEN 'websocket' ELSE 'file' END AS kind FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'ws://h/' || n_name ELSE './' || n_name || '.db' END AS u FROM nation)")
def fn26(t: Tables) -> DataFrame:
    url = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("ws://h/"), "n_name")).otherwise(F.concat(F.lit("./"), "n_name", F.lit(".db")))
    return t.nation.select(F.col("n_nationkey").alias("k"), T.remote_kind(url).alias("kind"))


@query("fn8_layer_seed", "SELECT n_nationkey AS k, [CAST(1 << (n_nationkey % 11) AS BIGINT), 0, 0, 0] AS bits FROM nation")
def fn8(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k"), S.bits(F.array((F.col("n_nationkey") % 11).cast("int"))).alias("bits"))


SLOTS = """w AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 32 AS slot, count(*) AS c FROM (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM w GROUP BY doc_id)"""


@query("sea2_embedding", f"WITH {SLOTS} SELECT d.doc_id, list(round(coalesce(c / norm, 0), 4) ORDER BY r.slot) AS embedding FROM documents d CROSS JOIN (SELECT unnest(range(32)) AS slot) r LEFT JOIN w ON w.doc_id = d.doc_id AND w.slot = r.slot LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id")
def sea2(t: Tables) -> DataFrame:
    """A deterministic stand-in for a text embedder: hashed counts of words."""
    vector = F.transform(S.hashed_embedding(F.col("text"), 32), lambda x: F.round(x, 4))
    return t.documents.select("doc_id", vector.alias("embedding"))

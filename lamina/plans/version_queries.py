"""Tree, merge, snapshot, history and working-copy queries: orders are documents of a tree, customers' orders a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import hashing as H
from lamina.operators import repository as R
from lamina.operators import versions as V
from lamina.plans.registry import Tables, query

# Trees by perturbing orders: path is the key, document the hash of two columns.
DOC = "'sha256:' || sha256(CAST(o_orderkey AS VARCHAR) || o_orderstatus{extra})"
TREES = f"""anc AS (SELECT o_orderkey AS path, {DOC.format(extra='')} AS document FROM orders WHERE o_orderkey % 17 <> 4),
ours AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN {DOC.format(extra=" || 'o'")} WHEN o_orderkey % 7 = 1 THEN {DOC.format(extra=" || 'b'")} ELSE {DOC.format(extra='')} END AS document FROM orders WHERE o_orderkey % 13 <> 5),
theirs AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN {DOC.format(extra=" || 't'")} WHEN o_orderkey % 7 = 1 THEN {DOC.format(extra=" || 'b'")} ELSE {DOC.format(extra='')} END AS document FROM orders WHERE o_orderkey % 19 <> 6)"""


def _doc(extra: str = "") -> Column:
    return H.prefixed(F.sha2(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit(extra)), 256))


def trees(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = t.orders.select("o_orderkey", "o_orderstatus")
    anc = base.where(k % 17 != 4).select(k.alias("path"), _doc().alias("document"))
    ours = base.where(k % 13 != 5).select(k.alias("path"), F.when(k % 7 == 0, _doc("o")).when(k % 7 == 1, _doc("b")).otherwise(_doc()).alias("document"))
    theirs = base.where(k % 19 != 6).select(k.alias("path"), F.when(k % 11 == 0, _doc("t")).when(k % 7 == 1, _doc("b")).otherwise(_doc()).alias("document"))
    return anc, ours, theirs


@query(
    "jon7_tree_diff",
    f"""WITH {TREES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.document IS NULL THEN 'added' WHEN b.document IS NULL THEN 'removed' ELSE 'modified' END AS status, a.document AS da, b.document AS db
  FROM anc a FULL JOIN ours b ON a.path = b.path WHERE a.document IS DISTINCT FROM b.document""",
)
def jon7(t: Tables) -> DataFrame:
    a, o, _ = trees(t)
    return V.tree_diff(a, o)


THREE = f"""{TREES}, j AS (SELECT coalesce(a.path, o.path, t.path) AS path, a.document AS a, o.document AS o, t.document AS t FROM anc a FULL JOIN ours o ON a.path = o.path FULL JOIN theirs t ON t.path = coalesce(a.path, o.path)),
merged AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM a AND t IS NOT DISTINCT FROM a THEN CASE WHEN a IS NULL THEN 'dropped' ELSE 'kept' END
    WHEN o IS NULL AND t IS NULL THEN 'dropped'
    WHEN o IS NOT DISTINCT FROM t THEN 'auto_merged' WHEN t IS NOT DISTINCT FROM a THEN 'ours_only' WHEN o IS NOT DISTINCT FROM a THEN 'theirs_only' ELSE 'conflict' END AS outcome FROM j),
final AS (SELECT *, CASE WHEN outcome <> 'conflict' THEN NULL WHEN a IS NULL THEN 'each side adds it in its own way' WHEN o IS NULL THEN 'ours deletes what theirs changes'
    WHEN t IS NULL THEN 'ours changes what theirs deletes' ELSE 'each side changes it in its own way' END AS reason,
    CASE outcome WHEN 'theirs_only' THEN t WHEN 'conflict' THEN coalesce(o, a) ELSE o END AS merged FROM merged)"""


@query("jon11_three_way_merge", f"WITH {THREE} SELECT path, a, o, t, outcome, reason, merged FROM final")
def jon11(t: Tables) -> DataFrame:
    return V.three_way(*trees(t), ["path"], "document")


for _strategy in ("ours", "theirs"):

    @query(
        f"grf12_strategy_{_strategy}",
        f"""WITH {THREE} SELECT path, outcome, CASE WHEN outcome <> 'conflict' THEN 'none' WHEN o IS NOT NULL AND t IS NOT NULL THEN '{_strategy}' ELSE 'divergence' END AS resolution,
  CASE WHEN outcome = 'conflict' AND o IS NOT NULL AND t IS NOT NULL THEN {_strategy[0]} ELSE merged END AS final FROM final""",
    )
    def grf12(t: Tables, strategy: str = _strategy) -> DataFrame:
        return V.resolved(V.three_way(*trees(t), ["path"], "document"), strategy).select("path", "outcome", "resolution", "final")


@query(
    "grf13_divergences",
    f"""WITH {THREE} SELECT path, '.layers/divergence/' || path || '.' || substr(sha256(unhex(replace(a, 'sha256:', '') || replace(o, 'sha256:', '') || replace(t, 'sha256:', ''))), 1, 16) AS side_path
  FROM final WHERE outcome = 'conflict' AND a IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL""",
)
def grf13(t: Tables) -> DataFrame:
    m = V.three_way(*trees(t), ["path"], "document").where("outcome = 'conflict' and a is not null and o is not null and t is not null")
    return m.select("path", H.divergence_path(F.col("path").cast("string"), F.col("a"), F.col("o"), F.col("t")).alias("side_path"))


@query("set4_all_paths", f"WITH {TREES} SELECT path FROM anc UNION SELECT path FROM ours UNION SELECT path FROM theirs")
def set4(t: Tables) -> DataFrame:
    a, o, th = trees(t)
    return a.select("path").union(o.select("path")).union(th.select("path")).distinct()


@query("prj6_conflicts", f"WITH {THREE} SELECT count(*) AS n, bool_or(outcome = 'conflict') AS has_conflicts, count(*) FILTER (outcome = 'conflict') AS n_conflicts FROM final")
def prj6(t: Tables) -> DataFrame:
    m = V.three_way(*trees(t), ["path"], "document")
    return m.agg(F.count("*").alias("n"), F.bool_or(F.col("outcome") == "conflict").alias("has_conflicts"), F.count_if(F.col("outcome") == "conflict").alias("n_conflicts"))


@query("grf9_merge_summary", f"WITH {THREE} SELECT outcome, count(*) AS n FROM final GROUP BY outcome")
def grf9(t: Tables) -> DataFrame:
    return V.three_way(*trees(t), ["path"], "document").groupBy("outcome").agg(F.count("*").alias("n"))


ATTRS = """{n} AS (SELECT p_partkey AS element, unnest(['brand', 'type', 'size']) AS attr, unnest([p_brand{b}, p_type{y}, CAST(p_size{z} AS VARCHAR)]) AS value FROM part{w})"""
ATTR_SQL = ", ".join(
    [
        ATTRS.format(n="xa", b="", y="", z="", w=""),
        ATTRS.format(n="xo", b=" || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END", y="", z="", w=" WHERE p_partkey % 10 <> 1"),
        ATTRS.format(n="xt", b=" || CASE WHEN p_partkey % 6 = 0 THEN '?' ELSE '' END", y="", z=" + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", w=""),
    ]
)


def attributes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    def long(df: DataFrame) -> DataFrame:
        return df.select(F.col("p_partkey").alias("element"), F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), c.alias("value")) for a, c in (("brand", F.col("b")), ("type", F.col("y")), ("size", F.col("z").cast("string")))])).alias("x")).select("element", "x.attr", "x.value")

    k = F.col("p_partkey")
    base = t.part.select("p_partkey", F.col("p_brand").alias("b"), F.col("p_type").alias("y"), F.col("p_size").alias("z"))
    ours = base.where(k % 10 != 1).withColumn("b", F.when(k % 3 == 0, F.concat("b", F.lit("!"))).otherwise(F.col("b")))
    theirs = base.withColumn("b", F.when(k % 6 == 0, F.concat("b", F.lit("?"))).otherwise(F.col("b"))).withColumn("z", F.when(k % 5 == 0, F.col("z") + 1).otherwise(F.col("z")))
    return long(base), long(ours), long(theirs)


@query(
    "jon9_attribute_diff",
    f"""WITH {ATTR_SQL} SELECT coalesce(a.element, b.element) AS element, coalesce(a.attr, b.attr) AS attr, CASE WHEN a.element IS NULL THEN 'added' WHEN b.element IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old, b.value AS new
  FROM xa a FULL JOIN xo b ON a.element = b.element AND a.attr = b.attr WHERE a.value IS DISTINCT FROM b.value""",
)
def jon9(t: Tables) -> DataFrame:
    a, o, _ = attributes(t)
    return V.attribute_diff(a, o, ["element", "attr"])


@query(
    "jon12_attribute_merge",
    f"""WITH {ATTR_SQL}, j AS (SELECT a.element, a.attr, a.value AS a, o.value AS o, t.value AS t FROM xa a LEFT JOIN xo o ON a.element = o.element AND a.attr = o.attr LEFT JOIN xt t ON a.element = t.element AND a.attr = t.attr),
  m AS (SELECT *, CASE WHEN o IS NULL THEN CASE WHEN t = a THEN 'ours_only' ELSE 'conflict' END WHEN o = t AND o = a THEN 'kept' WHEN o = t THEN 'auto_merged' WHEN t = a THEN 'ours_only' WHEN o = a THEN 'theirs_only' ELSE 'conflict' END AS outcome FROM j)
  SELECT element, attr, outcome, bool_or(outcome = 'conflict') OVER (PARTITION BY element) AS element_conflict FROM m""",
)
def jon12(t: Tables) -> DataFrame:
    return V.attribute_merge(*attributes(t), owner=["element"]).select("element", "attr", "outcome", "element_conflict")


@query(
    "jon8_child_diff",
    """WITH a AS (SELECT l_orderkey AS parent, l_linenumber AS ord, l_partkey AS child FROM lineitem), b AS (SELECT parent, CASE WHEN parent % 9 = 0 THEN ord + 1 ELSE ord END AS ord, child FROM a WHERE child % 50 <> 7)
  SELECT coalesce(a.parent, b.parent) AS parent, coalesce(a.ord, b.ord) AS ord, CASE WHEN a.child IS NULL THEN 'added' WHEN b.child IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.parent = b.parent AND a.ord = b.ord WHERE a.child IS DISTINCT FROM b.child""",
)
def jon8(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("value"))
    b = a.where("value % 50 <> 7").withColumn("ord", F.when(F.col("parent") % 9 == 0, F.col("ord") + 1).otherwise(F.col("ord")))
    return V.attribute_diff(a, b, ["parent", "ord"]).select("parent", "ord", "change")


@query(
    "win1_child_keys",
    "SELECT l_orderkey AS parent, l_returnflag AS name, l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem",
)
def win1(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("ord"))
    return V.child_keys(c, names=("name",))


@query(
    "win2_segments",
    """SELECT l_orderkey AS parent, l_linenumber AS ord, CASE WHEN l_linenumber = 2 THEN l_returnflag || '[@id="' || l_partkey || '"]'
    WHEN count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 THEN l_returnflag || '[' || row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) || ']' ELSE l_returnflag END AS segment FROM lineitem""",
)
def win2(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") == 2, F.col("l_partkey").cast("string")).alias("id"))
    return V.segments(c).select("parent", "ord", "segment")


SNAP = "src AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0), dst AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 1)"


@query("jon14_transfer", f"WITH {SNAP} SELECT DISTINCT hash FROM src WHERE hash NOT IN (SELECT hash FROM dst)")
def jon14(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return V.transfer(d.where("doc_id % 3 <> 0").select("hash"), d.where("doc_id % 4 <> 1"))


INDEX = """cur AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'h' || label END AS h FROM embeddings WHERE vec_id % 7 <> 2), want AS (SELECT vec_id AS id, 'h' || label AS h FROM embeddings WHERE vec_id % 11 <> 3),
changes AS (SELECT coalesce(c.id, w.id) AS id, CASE WHEN c.h IS NULL THEN 'new' WHEN w.h IS NULL THEN 'vanished' WHEN c.h = w.h THEN 'unchanged' ELSE 'changed' END AS change, c.h AS old, w.h AS new FROM cur c FULL JOIN want w ON c.id = w.id)"""


def index_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    h = F.concat(F.lit("h"), F.col("label").cast("string"))
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return e.where("id % 7 <> 2").select("id", F.when(F.col("id") % 5 == 0, "old").otherwise(h).alias("node_hash"), (F.col("id") * 2).alias("key")), e.where("id % 11 <> 3").select("id", h.alias("node_hash"))


@query("jon15_index_changes", f"WITH {INDEX} SELECT * FROM changes")
def jon15(t: Tables) -> DataFrame:
    return V.index_changes(*index_sides(t))


@query(
    "agg10_index_report",
    f"WITH {INDEX} SELECT count(*) FILTER (change IN ('new', 'changed')) AS re_embedded, count(*) FILTER (change = 'unchanged') AS reused, count(*) FILTER (change = 'vanished') AS removed, count(*) FILTER (change <> 'vanished') AS total FROM changes",
)
def agg10(t: Tables) -> DataFrame:
    return V.index_report(V.index_changes(*index_sides(t)))


@query(
    "sea3_stable_keys",
    f"""WITH {INDEX}, top AS (SELECT max(id * 2) AS top FROM cur)
  SELECT w.id, w.h AS node_hash, coalesce(c.id * 2, top + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY w.id)) AS key FROM want w LEFT JOIN cur c ON c.id = w.id, top""",
)
def sea3(t: Tables) -> DataFrame:
    return V.stable_keys(*index_sides(t))


@query("snk6_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 3 = 0")
def snk6(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return V.upsert(e.where("id % 3 = 0"), e.where("id % 4 = 0").withColumn("label", F.col("label") + 100), "id")


@query("snk1_transaction", "SELECT sha256(text) AS hash, max_by(doc_id, (doc_id % 3 = 1, doc_id)) AS doc_id FROM documents WHERE doc_id % 3 < 2 GROUP BY 1")
def snk1(t: Tables) -> DataFrame:
    """Documents of three puts: one is the table already, one is committed, one rolled back."""
    h = t.documents.select(F.sha2("text", 256).alias("hash"), "doc_id")
    part = lambda k: h.where(F.col("doc_id") % 3 == k).groupBy("hash").agg(F.max("doc_id").alias("doc_id"))
    kept = R.Transaction(part(0))
    kept.put(part(1))
    undone = R.Transaction(kept.commit())
    undone.put(part(2))
    return undone.rollback()


ASKED = """refs AS (SELECT o_custkey AS name, count(*) AS n FROM orders GROUP BY o_custkey),
asked AS (SELECT c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'old' WHEN 2 THEN 'other' ELSE 'old' END AS expected, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'new' END AS value FROM customer)"""


@query(
    "snk2_compare_and_set",
    f"""WITH {ASKED}, j AS (SELECT coalesce(a.name, r.name) AS name, r.name IS NOT NULL AS held, expected, value, CASE WHEN r.name IS NULL THEN expected IS NULL ELSE expected IS NOT DISTINCT FROM 'old' END AS done FROM asked a FULL JOIN refs r ON a.name = r.name)
  SELECT name, CASE WHEN done THEN value ELSE 'old' END AS hash FROM j WHERE CASE WHEN done THEN value IS NOT NULL ELSE held END""",
)
def snk2(t: Tables) -> DataFrame:
    refs = t.orders.select(F.col("o_custkey").alias("name")).distinct().withColumn("hash", F.lit("old"))
    k = F.col("c_custkey") % 4
    asked = t.customer.select(F.col("c_custkey").alias("name"), F.when(k == 2, "other").when(k != 0, "old").alias("expected"), F.when(k != 3, "new").alias("value"))
    return R.compare_and_set(refs, asked)[0]


WORK = """w AS (SELECT o_orderkey AS path, sha256(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 9 <> 2), d AS (SELECT o_orderkey AS path, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END) AS hash FROM orders WHERE o_orderkey % 8 <> 3),
g AS (SELECT o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' ELSE 'delete' END AS action, CASE WHEN o_orderkey % 3 <> 2 THEN sha256('S') END AS hash FROM orders WHERE o_orderkey % 13 = 4)"""


def work(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("path")
    o = t.orders.select(F.col("o_orderkey").alias("path"), "o_orderstatus")
    w = o.where(k % 9 != 2).select("path", F.sha2("o_orderstatus", 256).alias("hash"))
    d = o.where(k % 8 != 3).select("path", F.sha2(F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), 256).alias("hash"))
    g = o.where(k % 13 == 4).select("path", F.when(k % 3 == 0, "add").when(k % 3 == 1, "modify").otherwise("delete").alias("action"), F.when(k % 3 != 2, F.sha2(F.lit("S"), 256)).alias("hash"))
    return w, d, g


STATUS = f"""{WORK}, status AS (SELECT path, 'staged-' || action AS state FROM g UNION ALL
  SELECT path, state FROM (SELECT coalesce(w.path, d.path) AS path, CASE WHEN w.path IS NULL THEN 'untracked' WHEN d.path IS NULL THEN 'deleted' WHEN w.hash <> d.hash THEN 'modified' END AS state FROM w FULL JOIN d ON w.path = d.path)
  WHERE state IS NOT NULL AND path NOT IN (SELECT path FROM g))"""
@query("wrk3_status", f"WITH {STATUS} SELECT path, state FROM status")
def wrk3(t: Tables) -> DataFrame:
    return V.status(*work(t))


@query("jon16_status_join", f"WITH {WORK} SELECT coalesce(w.path, d.path, g.path) AS path, w.hash AS tracked, d.hash AS on_disk, g.action AS staged FROM w FULL JOIN d ON w.path = d.path FULL JOIN g ON g.path = coalesce(w.path, d.path)")
def jon16(t: Tables) -> DataFrame:
    return V.status_sides(*work(t))


@query("wrk1_add", f"WITH {WORK} SELECT d.path, CASE WHEN w.hash IS NOT NULL THEN 'modify' ELSE 'add' END AS action, d.hash FROM d LEFT JOIN w ON w.path = d.path UNION ALL SELECT path, action, hash FROM g WHERE path NOT IN (SELECT path FROM d)")
def wrk1(t: Tables) -> DataFrame:
    return V.stage_add(*work(t))


@query("wrk2_rm", f"WITH {WORK} SELECT path, action, hash FROM g WHERE path % 2 = 0 UNION ALL SELECT path, 'delete', NULL FROM w WHERE path % 2 = 1")
def wrk2(t: Tables) -> DataFrame:
    w, _, g = work(t)
    return V.stage_remove(g.where("path % 2 = 0"), w.where("path % 2 = 1"))


@query("wrk2_rm_cached", f"WITH {WORK} SELECT path, action, hash FROM g WHERE path NOT IN (SELECT path FROM w)")
def wrk2c(t: Tables) -> DataFrame:
    w, _, g = work(t)
    return V.stage_remove(g, w, cached=True)


@query("wrk4_commit", f"WITH {WORK} SELECT coalesce(w.path, g.path) AS path, coalesce(g.hash, w.hash) AS hash FROM w FULL JOIN g ON w.path = g.path WHERE g.action IS DISTINCT FROM 'delete'")
def wrk4(t: Tables) -> DataFrame:
    w, _, g = work(t)
    return V.committed_tree(w, g)


@query(
    "wrk5_clean_guard",
    f"WITH {WORK} SELECT (SELECT count(*) FROM g) AS n_staged, count(*) AS n_changed, (SELECT count(*) FROM g) = 0 AND count(*) = 0 AS clean FROM w LEFT JOIN d ON w.path = d.path WHERE d.path IS NULL OR d.hash <> w.hash",
)
def wrk5(t: Tables) -> DataFrame:
    return V.is_clean(*work(t))


@query("wrk6_checkout", f"WITH {WORK} SELECT coalesce(w.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'remove' ELSE 'write' END AS step FROM w FULL JOIN d ON w.path = d.path WHERE w.hash IS DISTINCT FROM d.hash")
def wrk6(t: Tables) -> DataFrame:
    w, d, _ = work(t)
    return V.checkout_plan(w, d)


@query("wrk7_overwrite_guard", f"WITH {WORK} SELECT path FROM g WHERE path IN (SELECT path FROM d) AND path NOT IN (SELECT w.path FROM w JOIN d ON w.path = d.path AND w.hash = d.hash)")
def wrk7(t: Tables) -> DataFrame:
    w, d, g = work(t)
    return V.overwrite_guard(g, w, d)


@query("wrk8_revert", f"WITH {WORK} SELECT g.path, CASE WHEN w.path IS NOT NULL THEN 'restore' ELSE 'warn' END AS step, w.hash AS h FROM g LEFT JOIN w ON w.path = g.path")
def wrk8(t: Tables) -> DataFrame:
    w, _, g = work(t)
    return V.revert_plan(g, w)


# Files of two trees: nations' documents, whose name or only the white space inside tags may differ.
FILES = """f AS (SELECT n_nationkey AS k, 'f' || n_nationkey || '.xml' AS path, n_name AS x FROM nation)"""


def nation_trees(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    xml = lambda name, gap="": F.concat(F.lit("<nation><label" + gap + ">"), name, F.lit("</label></nation>"))
    path = F.concat(F.lit("f"), k.cast("string"), F.lit(".xml")).alias("path")
    a = t.nation.where(k % 7 != 6).select(path, xml(F.col("n_name")).alias("xml"))
    b = t.nation.where(k % 7 != 5).select(path, F.when(k % 3 == 0, xml(F.lower("n_name"))).when(k % 3 == 1, xml(F.col("n_name"), " ")).otherwise(xml(F.col("n_name"))).alias("xml"))
    hashed = [df.withColumn("hash", H.text_hash(F.col("xml"))) for df in (a, b)]
    return hashed[0].select("path", "hash"), hashed[1].select("path", "hash"), hashed[0].union(hashed[1]).select("hash", "xml").distinct()


DIFF = f"""WITH {FILES} SELECT path, 'removed' AS status, NULL AS change, NULL AS at, NULL AS old, NULL AS new FROM f WHERE k % 7 = 5
  UNION ALL SELECT path, 'added', NULL, NULL, NULL, NULL FROM f WHERE k % 7 = 6
  UNION ALL SELECT path, 'modified', 'text-changed', '/nation/label/text()', x, lower(x) FROM f WHERE k % 7 < 5 AND k % 3 = 0"""


@query("wrk9_diff", DIFF)
def wrk9(t: Tables) -> DataFrame:
    """Working copy and disk: a file whose XML is the same is not listed."""
    return R.diff(*nation_trees(t), quiet=True)


@query("wrk9_diff_revisions", f"{DIFF} UNION ALL SELECT path, 'modified', NULL, NULL, NULL, NULL FROM f WHERE k % 7 < 5 AND k % 3 = 1")
def wrk9r(t: Tables) -> DataFrame:
    """Two revisions: every changed file is listed."""
    return R.diff(*nation_trees(t))


# Commits are turns of conversations; a commit's parent is the turn before it.
COMMITS = "commits AS (SELECT 'k' || conv_id || '.' || turn AS commit, CASE WHEN turn > 0 THEN 'k' || conv_id || '.' || (turn - 1) END AS parent, conv_id, turn FROM conversations)"


def commits(t: Tables) -> DataFrame:
    name = lambda turn: F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("."), turn.cast("string"))
    return t.conversations.select(name(F.col("turn")).alias("commit"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), "conv_id", "turn")


@query("win8_chain_parents", f"WITH {COMMITS} SELECT commit, lag(commit) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM commits")
def win8(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return commits(t).select("commit", F.lag("commit").over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent"))


TIPS = "tips AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)"


@query("top5_walk_history", f"WITH {COMMITS}, {TIPS} SELECT 'k' || t.conv_id || '.' || t.turn AS start, c.commit, t.turn - c.turn AS depth, t.turn - c.turn + 1 AS position FROM tips t JOIN commits c USING (conv_id) WHERE t.turn - c.turn < 4")
def top5(t: Tables) -> DataFrame:
    c = commits(t)
    tips = c.groupBy("conv_id").agg(F.max_by("commit", "turn").alias("commit"))
    return V.log(tips, c.where("parent is not null"), limit=4)


@query("wrk12_log", f"WITH {COMMITS}, {TIPS} SELECT 'k' || t.conv_id || '.' || t.turn AS start, count(*) AS n FROM tips t JOIN commits c USING (conv_id) GROUP BY 1")
def wrk12(t: Tables) -> DataFrame:
    c = commits(t)
    tips = c.groupBy("conv_id").agg(F.max_by("commit", "turn").alias("commit"))
    return V.log(tips, c.where("parent is not null")).groupBy("start").agg(F.count("*").alias("n"))


@query("grf5_common_ancestor", f"WITH {COMMITS}, {TIPS} SELECT 'k' || conv_id || '.' || turn AS a, 'k' || conv_id || '.' || (turn // 2) AS b, 'k' || conv_id || '.' || (turn // 2) AS ancestor, turn - turn // 2 AS distance FROM tips")
def grf5(t: Tables) -> DataFrame:
    c = commits(t)
    tips = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    name = lambda turn: F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("."), turn.cast("string"))
    return V.common_ancestors(tips.select(name(F.col("turn")).alias("a"), name(F.floor(F.col("turn") / 2)).alias("b")), c.where("parent is not null"))


@query(
    "grf10_sync_refs",
    f"""WITH {TIPS} SELECT 'b' || conv_id AS name, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN 'k' || conv_id || '.' || turn ELSE 'k' || conv_id || '.0' END AS old, 'k' || conv_id || '.' || turn AS new,
  CASE WHEN conv_id % 3 = 0 THEN 'create' WHEN conv_id % 3 = 1 OR turn = 0 THEN 'up-to-date' ELSE 'fast-forward' END AS step FROM tips""",
)
def grf10(t: Tables) -> DataFrame:
    c = commits(t)
    tips = c.groupBy("conv_id").agg(F.max_by("commit", "turn").alias("hash"), F.min_by("commit", "turn").alias("root"))
    name = F.concat(F.lit("b"), F.col("conv_id").cast("string")).alias("name")
    target = tips.where("conv_id % 3 <> 0").select(name, F.when(F.col("conv_id") % 3 == 1, F.col("hash")).otherwise(F.col("root")).alias("hash"))
    return V.sync_plan(tips.select(name, "hash"), target, c.where("parent is not null"), "ff-only")


@query("jon21_ancestry", f"WITH {COMMITS} SELECT commit AS a, 'k' || conv_id || '.0' AS b, turn AS distance FROM commits WHERE turn > 0")
def jon21(t: Tables) -> DataFrame:
    c = commits(t)
    h = V.history(c.select("commit"), c.where("parent is not null"))
    return h.where("commit like '%.0' and start <> commit").select(F.col("start").alias("a"), F.col("commit").alias("b"), F.col("depth").alias("distance"))


REFS = """refs AS (SELECT CASE WHEN n_nationkey = 0 THEN 'HEAD' WHEN n_nationkey % 2 = 0 THEN 'refs/heads/' || lower(n_name) ELSE 'refs/tags/' || lower(n_name) END AS name, 'sha256:' || sha256(n_name) AS hash, n_regionkey FROM nation)"""


def refs(t: Tables) -> DataFrame:
    low = F.lower("n_name")
    name = F.when(F.col("n_nationkey") == 0, F.lit("HEAD")).when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("refs/heads/"), low)).otherwise(F.concat(F.lit("refs/tags/"), low))
    return t.nation.select(name.alias("name"), H.text_hash(F.col("n_name")).alias("hash"), "n_regionkey")


@query("src10_list_refs", f"WITH {REFS} SELECT name, hash FROM refs WHERE starts_with(name, 'refs/heads/')")
def src10(t: Tables) -> DataFrame:
    return refs(t).where(V.has_prefix(F.col("name"), "refs/heads/")).select("name", "hash")


@query("wrk10_branches", f"WITH {REFS} SELECT substr(name, 12) AS branch, hash, name = 'refs/heads/nation_2' AS current FROM refs WHERE starts_with(name, 'refs/heads/') ORDER BY branch")
def wrk10(t: Tables) -> DataFrame:
    return R.branches(refs(t), "refs/heads/nation_2")


@query("wrk10_delete_branches", f"WITH {REFS} SELECT lower(n_name) AS branch, CASE WHEN n_nationkey = 2 THEN 'it is checked out' ELSE 'no such branch' END AS reason FROM nation WHERE n_nationkey IN (0, 2) OR n_nationkey % 2 = 1")
def wrk10d(t: Tables) -> DataFrame:
    return R.delete_branches(refs(t), t.nation.select(F.lower("n_name").alias("branch")), "refs/heads/nation_2")[1]


@query("wrk11_tags", "SELECT 'v' || n_nationkey AS tag, 'sha256:' || sha256('{\"tag\":\"v' || n_nationkey || '\",\"target\":\"' || 'sha256:' || sha256(n_name) || '\",\"message\":\"\"}') AS tag_hash, 'sha256:' || sha256(n_name) AS target FROM nation")
def wrk11(t: Tables) -> DataFrame:
    tags = t.nation.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("tag"), H.text_hash(F.col("n_name")).alias("target"), F.lit(None).cast("string").alias("message"))
    objects, named = R.tag_objects(tags, refs(t).where("false"))
    return R.tag_targets(named, objects)


@query("wrk13_clone", f"WITH {REFS}, h AS (SELECT name, hash FROM refs WHERE starts_with(name, 'refs/heads/')) SELECT name, hash, name = (SELECT min(name) FROM h) AS is_head FROM h")
def wrk13(t: Tables) -> DataFrame:
    heads, _, head = R.clone(refs(t), t.nation.select(H.text_hash(F.col("n_name")).alias("hash")))
    return heads.join(head.select(F.col("target").alias("name"), F.lit(True).alias("is_head")), "name", "left").select("name", "hash", F.coalesce("is_head", F.lit(False)).alias("is_head"))


@query("agg18_distinct_trees", f"WITH {REFS} SELECT n_regionkey AS tree, min(name) AS name FROM refs GROUP BY n_regionkey")
def agg18(t: Tables) -> DataFrame:
    return V.distinct_trees(refs(t).withColumnRenamed("n_regionkey", "tree"))


@query(
    "prj12_resolve_revision",
    f"""WITH {REFS}, revs AS (SELECT unnest(['HEAD', lower(n_name), 'refs/tags/' || lower(n_name), sha256(n_name), 'none' || n_nationkey]) AS rev FROM nation)
  SELECT rev, CASE WHEN regexp_full_match(rev, '[0-9a-fA-F]{{64}}') THEN 'sha256:' || rev ELSE coalesce((SELECT hash FROM refs r WHERE r.name = rev AND (rev = 'HEAD' OR starts_with(rev, 'refs/'))), (SELECT hash FROM refs r WHERE r.name = 'refs/heads/' || rev), (SELECT hash FROM refs r WHERE r.name = 'refs/tags/' || rev)) END AS hash FROM revs""",
)
def prj12(t: Tables) -> DataFrame:
    low = F.lower("n_name")
    revs = t.nation.select(F.explode(F.array(F.lit("HEAD"), low, F.concat(F.lit("refs/tags/"), low), F.sha2("n_name", 256), F.concat(F.lit("none"), F.col("n_nationkey").cast("string")))).alias("rev"))
    return V.resolve(revs, refs(t))


@query("prj13_first_document", "SELECT o_custkey AS tree, min(o_orderkey) AS path, arg_min(o_orderstatus, o_orderkey) AS document FROM orders GROUP BY o_custkey")
def prj13(t: Tables) -> DataFrame:
    return V.first_document(t.orders.select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("document")))


@query("top6_sorted_entries", "SELECT o_custkey AS tree, list_sort(list(o_orderkey)) AS paths FROM orders GROUP BY o_custkey")
def top6(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("tree")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("paths"))


@query("top8_sorted_status", f"WITH {STATUS} SELECT path, state FROM status ORDER BY path, state")
def top8(t: Tables) -> DataFrame:
    return V.status(*work(t)).orderBy("path", "state")

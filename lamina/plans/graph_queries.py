"""Graph queries: regions, nations, suppliers and customers are nodes; membership gives typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import graph as G
from lamina.operators import reports as P
from lamina.plans.registry import Tables, query

NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS tag FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer)"""
EDGES = """edges AS (SELECT 'refines' AS type, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'depends-on', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'references', 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
# A smaller node set leaves edges dangling.
PART = "part AS (SELECT id FROM nodes WHERE NOT (id LIKE 'n%' AND CAST(substr(id, 2) AS INT) % 7 = 3))"


def nodes(t: Tables) -> DataFrame:
    parts = [("r", "region", t.region, "r_regionkey"), ("n", "nation", t.nation, "n_nationkey"), ("s", "supplier", t.supplier, "s_suppkey"), ("c", "customer", t.customer, "c_custkey")]
    out = None
    for letter, tag, df, key in parts:
        one = df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(tag).alias("tag"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(t: Tables) -> DataFrame:
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    none = F.lit(None).cast("string").alias("to_spec")
    out = t.nation.select(F.lit("refines").alias("type"), name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), none)
    out = out.unionByName(t.supplier.select(F.lit("depends-on").alias("type"), name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), none))
    return out.unionByName(t.customer.select(F.lit("references").alias("type"), name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), none))


def some_nodes(t: Tables) -> DataFrame:
    return nodes(t).where("not (id like 'n%' and cast(substr(id, 2) as int) % 7 = 3)")


@query("grf1_graph_extraction", f"WITH {NODES} SELECT tag, count(*) AS n FROM nodes GROUP BY tag")
def grf1(t: Tables) -> DataFrame:
    return nodes(t).dropDuplicates(["id"]).groupBy("tag").agg(F.count("*").alias("n"))


@query("jon1_live_edges", f"WITH {NODES}, {EDGES}, {PART} SELECT type, src, dst FROM edges WHERE src IN (SELECT id FROM part) AND dst IN (SELECT id FROM part)")
def jon1(t: Tables) -> DataFrame:
    return G.live_edges(some_nodes(t), edges(t)).select("type", "src", "dst")


@query(
    "jon2_dangling_ends",
    f"""WITH {NODES}, {EDGES}, {PART} SELECT type, src, dst, 'from' AS side, src AS missing FROM edges WHERE src NOT IN (SELECT id FROM part)
  UNION ALL SELECT type, src, dst, 'to', dst FROM edges WHERE dst NOT IN (SELECT id FROM part)""",
)
def jon2(t: Tables) -> DataFrame:
    return G.dangling(some_nodes(t), edges(t))


@query("jon3_missing_parents", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def jon3(t: Tables) -> DataFrame:
    return P.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_custkey % 3 <> 0"), "c_custkey")


@query(
    "agg1_density",
    f"""WITH {NODES}, {EDGES}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges)
  SELECT n AS n_nodes, e AS n_edges, e / (CAST(n AS DOUBLE) * (n - 1)) AS density FROM n, e""",
)
def agg1(t: Tables) -> DataFrame:
    return G.density(nodes(t), edges(t))


@query("agg2_type_counts", f"WITH {EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type")
def agg2(t: Tables) -> DataFrame:
    return G.type_counts(edges(t))


@query("top9_types_by_count", f"WITH {EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC, type")
def top9(t: Tables) -> DataFrame:
    return G.type_counts(edges(t))


DEGREES = f"""{NODES}, {EDGES}, degrees AS (SELECT id, (SELECT 0) + coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree
  FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY dst) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY src) USING (id))"""


@query("agg3_degrees", f"WITH {DEGREES} SELECT id, in_degree, out_degree, degree FROM degrees")
def agg3(t: Tables) -> DataFrame:
    return G.degrees(nodes(t), edges(t))


@query("top1_hubs", f"WITH {DEGREES} SELECT id, in_degree, out_degree, degree FROM degrees ORDER BY degree DESC, id LIMIT 5")
def top1(t: Tables) -> DataFrame:
    return G.hubs(nodes(t), edges(t))


@query("top3_isolated", f"WITH {NODES}, {EDGES}, {PART} SELECT id FROM part WHERE id NOT IN (SELECT src FROM edges WHERE dst IN (SELECT id FROM part)) AND id NOT IN (SELECT dst FROM edges)")
def top3(t: Tables) -> DataFrame:
    return G.isolated(some_nodes(t), edges(t))


@query(
    "agg22_components",
    f"""WITH {NODES}, {EDGES}, {PART}, live AS (SELECT * FROM edges WHERE src IN (SELECT id FROM part) AND dst IN (SELECT id FROM part)),
  up AS (SELECT p.id, coalesce(e1.dst, p.id) AS a FROM part p LEFT JOIN live e1 ON e1.src = p.id),
  top AS (SELECT up.id, coalesce(e2.dst, up.a) AS root FROM up LEFT JOIN live e2 ON e2.src = up.a)
  SELECT min(id) AS component, count(*) AS size FROM top GROUP BY root""",
)
def agg22(t: Tables) -> DataFrame:
    return G.component_sizes(some_nodes(t), edges(t))


@query("jon19_drawn_edges", f"WITH {NODES}, {EDGES}, {PART} SELECT src, dst, count(*) AS n FROM edges WHERE src IN (SELECT id FROM part) AND dst IN (SELECT id FROM part) GROUP BY src, dst")
def jon19(t: Tables) -> DataFrame:
    return P.edge_counts(G.live_edges(some_nodes(t), edges(t)))


# Paths run from a customer or supplier over its nation to the region: a nation lies on as many as it has of both.
BETWEEN = f"""WITH {NODES}, {EDGES}, n AS (SELECT count(*) AS n FROM nodes), b AS (SELECT dst AS id, count(*) AS c FROM edges WHERE dst LIKE 'n%' AND dst IN (SELECT src FROM edges) GROUP BY dst)
  SELECT id, c / (CAST(n - 1 AS DOUBLE) * (n - 2)) AS score FROM b, n"""


@query("grf2_betweenness", BETWEEN)
def grf2(t: Tables) -> DataFrame:
    return G.betweenness(nodes(t), edges(t))


@query("top2_bridges", f"{BETWEEN} ORDER BY score DESC, id LIMIT 5")
def top2(t: Tables) -> DataFrame:
    return G.bridges(nodes(t), edges(t))


def ring(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations in rings by region: each depends on the next of its region, the last references the first."""
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    per = n.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("a"))
    e = per.select(F.explode(F.transform("a", lambda x, i: F.struct(F.when(i == F.size("a") - 1, "references").otherwise("depends-on").alias("type"), x["id"].alias("src"), F.get("a", (i + 1) % F.size("a"))["id"].alias("dst")))).alias("e"))
    return n.select("id", F.lit("nation").alias("tag")), e.select("e.type", "e.src", "e.dst", F.lit(None).cast("string").alias("to_spec"))


@query(
    "grf3_cycles",
    """WITH m AS (SELECT n_regionkey AS r, list_sort(list('n' || n_nationkey)) AS members, count(*) AS c FROM nation GROUP BY n_regionkey)
  SELECT members[1] AS component, members, CASE WHEN c > 1 THEN ['depends-on', 'references'] ELSE ['references'] END AS types, c > 1 AS violation FROM m""",
)
def grf3(t: Tables) -> DataFrame:
    return G.cycles(*ring(t))


@query(
    "agg9_cycle_types",
    """SELECT type, count(*) AS cycles, count(*) FILTER (c > 1) AS violations FROM (
  SELECT unnest(CASE WHEN c > 1 THEN ['depends-on', 'references'] ELSE ['references'] END) AS type, c FROM (SELECT count(*) AS c FROM nation GROUP BY n_regionkey)) GROUP BY type""",
)
def agg9(t: Tables) -> DataFrame:
    found = G.cycles(*ring(t)).select(F.explode("types").alias("type"), "violation")
    return found.groupBy("type").agg(F.count("*").alias("cycles"), F.count_if("violation").alias("violations"))


@query(
    "grf4_subtree_closure",
    """SELECT 'r' || r_regionkey AS root, count(*) AS objects FROM (
  SELECT r_regionkey, 'r' AS o FROM region UNION ALL SELECT n_regionkey, 'n' FROM nation UNION ALL SELECT n_regionkey, 's' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'c' FROM customer JOIN nation ON c_nationkey = n_nationkey)
  GROUP BY r_regionkey""",
)
def grf4(t: Tables) -> DataFrame:
    e = edges(t).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return G.closure(nodes(t).where("tag = 'region'"), e).groupBy("root").agg(F.count("*").alias("objects"))


# Customers and suppliers of a nation, and orders, as three kinds of edges around nations.
KINDS = """raw AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'relation' AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'implements' WHEN c_custkey % 3 = 1 THEN 'refines' ELSE 'other' END AS relation, 0 AS seq FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'term-ref', '', 1 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || (c_custkey % 25), 'artifact-map', '', 2 FROM customer),
adjacent AS (SELECT a AS node, b AS neighbour, kind, relation, seq FROM raw UNION ALL SELECT b, a, kind, relation, seq FROM raw),
scored AS (SELECT *, CASE kind WHEN 'relation' THEN 100 + CASE relation WHEN 'implements' THEN 6 WHEN 'refines' THEN 4 ELSE 0 END WHEN 'artifact-map' THEN 90 ELSE 10 END AS score FROM adjacent WHERE node <> neighbour),
best AS (SELECT node, neighbour, kind, relation, score FROM (SELECT *, row_number() OVER (PARTITION BY node, neighbour ORDER BY score DESC, seq, kind, relation) AS k FROM scored) WHERE k = 1)"""


def kinds(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, n = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "implements").when(F.col("c_custkey") % 3 == 1, "refines").otherwise("other")
    rel = t.customer.select(c.alias("src"), n.alias("dst"), kind.alias("type"))
    term = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    art = t.customer.select(c.alias("src"), F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("dst"))
    return rel, term, art


@query("set6_adjacent", f"WITH {KINDS} SELECT kind, count(*) AS n, sum(score) AS total FROM scored GROUP BY kind")
def set6(t: Tables) -> DataFrame:
    return G.adjacent(*kinds(t)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("win5_best_edges", f"WITH {KINDS} SELECT * FROM best")
def win5(t: Tables) -> DataFrame:
    return G.best_edges(G.adjacent(*kinds(t)))


@query(
    "win4_diverse_neighbours",
    f"WITH {KINDS} SELECT node, neighbour, kind, relation, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY node, kind ORDER BY score DESC, neighbour) AS rank FROM best) WHERE rank <= 2",
)
def win4(t: Tables) -> DataFrame:
    return G.diverse(G.best_edges(G.adjacent(*kinds(t))))


@query("agg8_neighbour_counts", f"WITH {KINDS} SELECT node, kind, count(*) AS n FROM best GROUP BY node, kind")
def agg8(t: Tables) -> DataFrame:
    return G.best_edges(G.adjacent(*kinds(t))).groupBy("node", "kind").agg(F.count("*").alias("n"))


@query(
    "grf8_neighbours",
    f"""WITH {KINDS}, d AS (SELECT node AS neighbour, count(*) AS degree FROM best GROUP BY node),
  own AS (SELECT b.*, degree FROM best b JOIN d USING (neighbour) WHERE b.node = 'n3' AND degree <= 12)
  SELECT neighbour, node, kind, relation, score, degree, rank FROM (SELECT *, row_number() OVER (PARTITION BY node, kind ORDER BY score DESC, neighbour) AS rank FROM own) WHERE rank <= 2""",
)
def grf8(t: Tables) -> DataFrame:
    return G.neighbours("n3", G.adjacent(*kinds(t)))


@query("top7_candidates", f"WITH {KINDS} SELECT neighbour, score FROM best WHERE node = 'n3' ORDER BY score DESC, neighbour")
def top7(t: Tables) -> DataFrame:
    return G.best_edges(G.adjacent(*kinds(t))).where("node = 'n3'").orderBy(F.desc("score"), "neighbour").select("neighbour", "score")


@query("agg20_relations_by_type", f"WITH {EDGES} SELECT type, list_sort(list(DISTINCT dst)) AS targets, count(*) AS n FROM edges GROUP BY type")
def agg20(t: Tables) -> DataFrame:
    return P.edges_by_type(edges(t))


@query("agg19_synthesised_relations", "SELECT 'c' || o_custkey AS src, 'p' || o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY ALL")
def agg19(t: Tables) -> DataFrame:
    return P.edge_counts(t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), "o_orderpriority").alias("dst")))


@query("agg12_section_counters", f"WITH {EDGES} SELECT dst AS id, count(*) FILTER (type = 'refines') AS refined, count(*) FILTER (type = 'references') AS referenced, count(*) FILTER (type = 'depends-on') AS needed FROM edges GROUP BY dst")
def agg12(t: Tables) -> DataFrame:
    return P.counters(edges(t), {"refined": "refines", "referenced": "references", "needed": "depends-on"})


@query("set8_disjoint_types", f"WITH {EDGES} SELECT dst, bool_or(type IN ('depends-on', 'precedes')) AS overlaps FROM edges GROUP BY dst")
def set8(t: Tables) -> DataFrame:
    types = edges(t).groupBy("dst").agg(F.collect_set("type").alias("types"))
    return types.select("dst", F.arrays_overlap("types", F.array(*[F.lit(a) for a in G.ACYCLIC])).alias("overlaps"))

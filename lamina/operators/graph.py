"""Graph operators over ``nodes(id, tag)`` and ``edges(type, src, dst, to_spec)``.

Edges may repeat (a multigraph). Null ends match no node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import edge_score
from lamina.operators.tables import Grown, settled

#: Relation types that must not form cycles.
ACYCLIC = ("depends-on", "precedes")


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``type, src, dst, side, missing``: ends that are no nodes; ends in other specs and ids that start with ``type-`` are exempt."""
    ids = nodes.select(F.col("id").alias("missing")).distinct()
    inner = edges.where("to_spec is null")
    sides = inner.select("type", "src", "dst", F.lit("from").alias("side"), F.col("src").alias("missing")).union(inner.select("type", "src", "dst", F.lit("to").alias("side"), F.col("dst").alias("missing")))
    return sides.where(~F.col("missing").startswith("type-")).join(ids, "missing", "left_anti").select("type", "src", "dst", "side", "missing")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, density``; parallel edges count, dangling ones do not."""
    n = nodes.select("id").distinct().agg(F.count("*").alias("n_nodes"))
    e = live_edges(nodes, edges).agg(F.count("*").alias("n_edges"))
    size = F.col("n_nodes").cast("double")
    return n.crossJoin(e).withColumn("density", F.when(size > 1, F.col("n_edges") / (size * (size - 1))).otherwise(F.lit(0.0)))


def type_counts(edges: DataFrame) -> DataFrame:
    """Edges by type, dangling ones included, ends in other specs not; most frequent first."""
    return edges.where("to_spec is null").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree``; one pass over the edges, partially aggregated before the shuffle."""
    ends = live_edges(nodes, edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counted = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = nodes.select("id").distinct().join(counted, "id", "left")
    return joined.select("id", zero(F.col("in_degree")).alias("in_degree"), zero(F.col("out_degree")).alias("out_degree"), (zero(F.col("in_degree")) + zero(F.col("out_degree"))).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(k)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).where("degree = 0").select("id").orderBy("id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable, direction ignored): least labels spread, with pointer jumping each round."""
    e = live_edges(nodes, edges).select("src", "dst")
    both = settled(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = settled(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(least, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("far"))
        nxt = settled(step.join(jump, "low").select("id", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")))
        label = nxt.select("id", "component")
        if nxt.where("moved").isEmpty():
            return label


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, size``, largest first."""
    return components(nodes, edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def _reach(start: DataFrame, edges: DataFrame, names: tuple[str, str]) -> DataFrame:
    """All (root, id) pairs along ``edges`` from ``start(root, id)``: frontier joins, each pair once; a round writes its new pairs only."""
    seen = Grown(start.distinct())
    steps = settled(edges.select(F.col(names[0]).alias("id"), F.col(names[1]).alias("next")).distinct())
    while True:
        new = seen.last.join(steps, "id").select("root", F.col("next").alias("id")).distinct()
        if seen.append(new.join(seen.all(), ["root", "id"], "left_anti")).isEmpty():
            return seen.all()


def closure(roots: DataFrame, children: DataFrame) -> DataFrame:
    """``root, id``: every object below each root (itself included) once, along ``children(parent, child)``."""
    return _reach(roots.select(F.col("id").alias("root"), "id"), children, ("parent", "child"))


def _least_reaching(arcs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, color``: the least id that reaches a node along ``arcs(src, dst)``, itself included. One row per node in every round."""
    color = settled(ids.select("id", F.col("id").alias("color")))
    while True:
        near = arcs.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("near"))
        low = F.least("color", F.coalesce("near", "color"))
        nxt = settled(color.join(near, "id", "left").select("id", low.alias("color"), (low < F.col("color")).alias("moved")))
        color = nxt.select("id", "color")
        if nxt.where("moved").isEmpty():
            return color


def strong_components(arcs: DataFrame) -> DataFrame:
    """``id, component`` of the strongly connected sets of ``arcs(src, dst)`` that hold an arc; component is a set's least id.

    Nodes without an arc in or out are peeled off, round by round. In the rest,
    every node takes the least id that reaches it as its colour; those that also
    reach that id inside the colour are one set, and the others go on. Rows stay
    one per node, whatever the size of a set.
    """
    left = settled(arcs.select("src", "dst").distinct())
    found = Grown(left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0))
    while True:
        count = -1
        while count != (count := left.count()) and count:
            left = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if not count:
            return found.all()
        ids = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        color = _least_reaching(left, ids)
        inside = left.join(color.select(F.col("id").alias("src"), "color"), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").where("color = c2")
        # Backwards from each colour's own node, within the colour.
        back = _reach(color.where("id = color").select(F.col("color").alias("root"), "id"), inside.select("src", "dst"), ("dst", "src"))
        own = settled(back.select("id", F.col("root").alias("component")))
        held = own.join(inside.select(F.col("src").alias("id")).union(inside.select("dst")).distinct(), "id", "left_semi")
        sizes = held.groupBy("component").agg(F.count("*").alias("n"))
        loops = left.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
        real = sizes.join(loops, "component", "left").where("n > 1 or loop").select("component")
        found.append(held.join(real, "component", "left_semi").select("id", "component"))
        done = own.select("id")
        left = settled(left.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))


def cycles(nodes: DataFrame, edges: DataFrame, acyclic: tuple[str, ...] = ACYCLIC) -> DataFrame:
    """``component, members, types, violation``: strongly connected sets of several nodes, or of one with an edge to itself."""
    e = settled(live_edges(nodes, edges).select("src", "dst", "type").distinct())
    label = settled(strong_components(e))
    inner = e.join(label.withColumnRenamed("id", "src"), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    types = inner.groupBy("component").agg(F.array_sort(F.collect_set("type")).alias("types"))
    members = label.groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("members"))
    bad = F.arrays_overlap("types", F.array(*[F.lit(t) for t in acyclic]))
    return members.join(types, "component").select("component", "members", "types", bad.alias("violation"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = None) -> DataFrame:
    """``id, score``: directed, unweighted; parallel edges multiply paths; divided by (n-1)(n-2) where n > 2; scores above 0 only.

    Shortest paths are counted level by level from all sources at once, then
    shares are summed back up, level by level: joins and sums on (source, node),
    nothing is held in one place. Rows are the reachable pairs; on graphs where
    those are too many, ``sources`` takes that many nodes, the first by a hash of
    the id, and scales up: every score's standard error is then at most
    ``1 / (2 sqrt(sources))`` in units of n / (n - 2).
    """
    live = settled(live_edges(nodes, edges).where("src <> dst").groupBy(F.col("src").alias("v"), F.col("dst").alias("w")).agg(F.count("*").cast("double").alias("m")))
    ids = nodes.select("id").distinct()
    n = ids.count()
    start = ids if sources is None else ids.orderBy(F.xxhash64("id"), "id").limit(sources)
    seen = Grown(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    levels = [seen.last]
    while True:
        ahead = seen.last.join(live, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        if seen.append(ahead.join(seen.all().select("s", "v"), ["s", "v"], "left_anti")).isEmpty():
            break
        levels.append(seen.last)
    share = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("share"))
    totals = Grown(ids.select("id", F.lit(0.0).alias("part")).limit(0))
    for level in range(len(levels) - 1, 0, -1):
        totals.append(share.where("s <> v and share > 0").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("part")))
        behind = share.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("each"))
        back = levels[level - 1].join(live, "v").join(behind, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("m") * F.col("each")).alias("share"))
        share = settled(levels[level - 1].join(back, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share")))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (1.0 if sources is None or sources >= n else n / sources)
    return totals.all().groupBy("id").agg((F.sum("part") * scale).alias("score")).where("score > 0")


def bridges(nodes: DataFrame, edges: DataFrame, k: int = 5, sources: int | None = None) -> DataFrame:
    return betweenness(nodes, edges, sources).orderBy(F.desc("score"), "id").limit(k)


def adjacent(relations: DataFrame, term_refs: DataFrame, mappings: DataFrame) -> DataFrame:
    """``node, neighbour, kind, relation, score, seq``: three kinds of edges in both directions, without loops."""
    parts = [(relations, "relation", F.col("type"), 0), (term_refs, "term-ref", F.lit(""), 1), (mappings, "artifact-map", F.lit(""), 2)]
    out = None
    for df, kind, relation, seq in parts:
        for a, b in (("src", "dst"), ("dst", "src")):
            one = df.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), F.lit(kind).alias("kind"), relation.alias("relation"), F.lit(seq).alias("seq"))
            out = one if out is None else out.unionByName(one)
    out = out.where("node <> '' and neighbour <> '' and node <> neighbour")
    return out.withColumn("score", edge_score(F.col("kind"), F.col("relation")))


def best_edges(edges: DataFrame) -> DataFrame:
    """The best edge to each neighbour; the earlier kind on ties. A grouped minimum, so a hub's edges meet pre-aggregated."""
    key = F.struct((-F.col("score")).alias("s"), "seq", "kind", "relation")
    return edges.groupBy("node", "neighbour").agg(F.min(key).alias("k")).select("node", "neighbour", "k.kind", "k.relation", (-F.col("k.s")).alias("score"))


def diverse(edges: DataFrame, per_kind: int = 2) -> DataFrame:
    """Of each kind the best few neighbours, score falling, id rising."""
    w = Window.partitionBy("node", "kind").orderBy(F.desc("score"), "neighbour")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_kind)


def neighbours(node: Column | str, edges: DataFrame, hub_degree: int = 12, per_kind: int = 2) -> DataFrame:
    """Diverse best neighbours of one node; neighbours of too high a degree are left out after degrees are taken."""
    node = F.lit(node) if isinstance(node, str) else node
    best = best_edges(edges)
    degree = best.groupBy(F.col("node").alias("neighbour")).agg(F.count("*").alias("degree"))
    own = best.where(F.col("node") == node).join(degree, "neighbour", "left").where(F.coalesce("degree", F.lit(0)) <= hub_degree)
    return diverse(own, per_kind)

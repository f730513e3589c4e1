"""Trees, merges, snapshots, histories and working copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.tables import Grown, dealt, settled


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``path, status`` (added, removed, modified) of two trees ``path, document``."""
    x, y = a.select("path", F.col("document").alias("da")), b.select("path", F.col("document").alias("db"))
    status = F.when(F.col("da").isNull(), "added").when(F.col("db").isNull(), "removed").when(F.col("da") != F.col("db"), "modified")
    return x.join(y, "path", "full_outer").select("path", status.alias("status"), "da", "db").where("status is not null")


def attribute_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of ``keys, value`` rows: added, removed, changed, with both values."""
    x, y = a.select(*keys, F.col("value").alias("old"), F.lit(True).alias("in_a")), b.select(*keys, F.col("value").alias("new"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return x.join(y, keys, "full_outer").select(*keys, change.alias("change"), "old", "new").where("change is not null")


def child_keys(children: DataFrame, parent: str = "parent", names: tuple[str, ...] = ("kind", "name"), order: str = "ord") -> DataFrame:
    """Adds ``occurrence``: how many like-named siblings stand before."""
    w = Window.partitionBy(parent, *names).orderBy(order)
    return dealt(children, parent, *names).withColumn("occurrence", F.row_number().over(w) - 1)


def segments(children: DataFrame, parent: str = "parent", order: str = "ord") -> DataFrame:
    """Adds ``segment``: ``name[@id="x"]``, else ``name[position]`` where several siblings share the name, else ``name``.

    Siblings are counted over the window that numbers them, so that a task sorts its rows once.
    """
    w = Window.partitionBy(parent, "name").orderBy(order)
    at = F.row_number().over(w)
    several = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 1
    with_id = F.concat("name", F.lit('[@id="'), "id", F.lit('"]'))
    return dealt(children, parent, "name").withColumn("segment", F.when(F.col("id").isNotNull(), with_id).when(several, F.concat("name", F.lit("["), at.cast("string"), F.lit("]"))).otherwise(F.col("name")))


def three_way(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, a, o, t, outcome, reason, merged`` of a three-way merge; outcomes: kept, ours_only, theirs_only, auto_merged, conflict, dropped.

    A side deleted against a change is a conflict; its placeholder is the
    ancestor, so a deletion on our side brings the ancestor back.
    """
    sides = [df.select(*keys, F.col(value).alias(n)) for df, n in ((ancestor, "a"), (ours, "o"), (theirs, "t"))]
    j = reduce(lambda x, y: x.join(y, keys, "full_outer"), sides)
    a, o, t = F.col("a"), F.col("o"), F.col("t")
    outcome = (
        F.when(o.isNull() & t.isNull(), "dropped")
        .when(a.isNull() & t.isNull(), "ours_only")
        .when(a.isNull() & o.isNull(), "theirs_only")
        .when(a.isNull() & (o == t), "auto_merged")
        .when(a.isNull(), "conflict")
        .when(o.isNull(), F.when(t == a, "dropped_ours").otherwise("conflict"))
        .when(t.isNull(), F.when(o == a, "dropped_theirs").otherwise("conflict"))
        .when((o == t) & (o == a), "kept")
        .when(o == t, "auto_merged")
        .when(t == a, "ours_only")
        .when(o == a, "theirs_only")
        .otherwise("conflict")
    )
    j = j.withColumn("how", outcome)
    reason = F.when(
        F.col("how") == "conflict",
        F.when(a.isNull(), "each side adds it in its own way").when(o.isNull(), "ours deletes what theirs changes").when(t.isNull(), "ours changes what theirs deletes").otherwise("each side changes it in its own way"),
    )
    merged = F.when(F.col("how").startswith("dropped"), F.lit(None)).when(F.col("how") == "theirs_only", t).when((F.col("how") == "conflict") & o.isNull(), a).otherwise(o)
    named = F.when(F.col("how") == "dropped_ours", "ours_only").when(F.col("how") == "dropped_theirs", "theirs_only").otherwise(F.col("how"))
    return j.select(*keys, "a", "o", "t", named.alias("outcome"), reason.alias("reason"), merged.alias("merged"))


def resolved(merged: DataFrame, strategy: str) -> DataFrame:
    """Conflicts of :func:`three_way` under ours, theirs or manual (adds ``resolution``, ``final``); deletion against change always diverges."""
    both = F.col("o").isNotNull() & F.col("t").isNotNull()
    conflict = F.col("outcome") == "conflict"
    side = {"ours": F.col("o"), "theirs": F.col("t")}.get(strategy)
    if side is None:
        return merged.withColumn("resolution", F.when(conflict, "divergence").otherwise("none")).withColumn("final", F.col("merged"))
    return merged.withColumn("resolution", F.when(conflict & both, strategy).when(conflict, "divergence").otherwise("none")).withColumn("final", F.when(conflict & both, side).otherwise(F.col("merged")))


def attribute_merge(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, owner: list[str], name: str = "attr") -> DataFrame:
    """Three-way merge of attributes; ``element_conflict`` marks every attribute of an element with one conflict."""
    rows = three_way(ancestor, ours, theirs, [*owner, name], "value")
    hit = F.max((F.col("outcome") == "conflict").cast("int")).over(Window.partitionBy(*owner))
    return rows.withColumn("element_conflict", hit == 1)


def transfer(source: DataFrame, target: DataFrame, key: str = "hash") -> DataFrame:
    """Objects of the source that the target lacks, each once."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def index_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, change`` (new, changed, unchanged, vanished) of ``id, node_hash`` rows."""
    x, y = current.select("id", F.col("node_hash").alias("old")), wanted.select("id", F.col("node_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "vanished").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return x.join(y, "id", "full_outer").select("id", change.alias("change"), "old", "new")


def index_report(changes: DataFrame) -> DataFrame:
    """One row: ``re_embedded, reused, removed, total``."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.agg(n("new", "changed").alias("re_embedded"), n("unchanged").alias("reused"), n("vanished").alias("removed"), n("new", "changed", "unchanged").alias("total"))


def stable_keys(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, node_hash, key``: known ids keep their key, new ones count on from the largest, in order of id.

    The running number comes from counts per range partition, not from one sorted task.
    """
    top = current.agg(F.coalesce(F.max("key"), F.lit(0)).alias("top"))
    kept = wanted.join(current.select("id", "key"), "id", "left")
    new = settled(kept.where("key is null").select("id", "node_hash").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    before = new.groupBy("part").agg(F.count("*").alias("n"))
    offsets = before.withColumn("skip", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one row per partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    numbered = new.join(F.broadcast(offsets), "part").crossJoin(F.broadcast(top)).select("id", "node_hash", (F.col("top") + F.col("skip") + rank).alias("key"))
    return kept.where("key is not null").select("id", "node_hash", "key").unionByName(numbered)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace those of ``table`` with the same key; one merge, no update in place."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def status(working: DataFrame, disk: DataFrame, staging: DataFrame) -> DataFrame:
    """``path, state`` of a working copy: staged actions, and modified, deleted, untracked paths that are not staged."""
    staged = staging.select("path", F.concat(F.lit("staged-"), "action").alias("state"))
    j = working.select("path", F.col("hash").alias("w"), F.lit(True).alias("tracked")).join(disk.select("path", F.col("hash").alias("d")), "path", "full_outer")
    state = F.when(F.col("tracked").isNull(), "untracked").when(F.col("d").isNull(), F.when(F.col("w").isNotNull(), "deleted")).when(~F.col("w").eqNullSafe(F.col("d")), "modified")
    rest = j.select("path", state.alias("state")).where("state is not null").join(staging.select("path"), "path", "left_anti")
    return staged.unionByName(rest)


def status_sides(working: DataFrame, disk: DataFrame, staging: DataFrame) -> DataFrame:
    """``path, tracked, on_disk, staged``: what the working copy, the disk and the staging area hold of each path."""
    sides = [working.select("path", F.col("hash").alias("tracked")), disk.select("path", F.col("hash").alias("on_disk")), staging.select("path", F.col("action").alias("staged"))]
    return reduce(lambda a, b: a.join(b, "path", "full_outer"), sides)


def stage_add(working: DataFrame, disk: DataFrame, staging: DataFrame) -> DataFrame:
    """Staging after ``add`` of all disk paths: modify where tracked with a hash, else add."""
    w = working.select("path", F.col("hash").alias("w"))
    rows = disk.join(w, "path", "left").select("path", F.when(F.col("w").isNotNull(), "modify").otherwise("add").alias("action"), "hash")
    return upsert(staging, rows, "path")


def stage_remove(staging: DataFrame, paths: DataFrame, cached: bool = False) -> DataFrame:
    """Staging after ``rm``: a delete action per path; ``cached`` takes staged actions back."""
    if cached:
        return staging.join(paths.select("path"), "path", "left_anti")
    return upsert(staging, paths.select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("hash")), "path")


def committed_tree(working: DataFrame, staging: DataFrame) -> DataFrame:
    """``path, hash`` of the tree a commit writes: the working copy overlaid by the staged actions."""
    g = staging.select("path", "action", F.col("hash").alias("g"))
    j = working.select("path", F.col("hash").alias("w")).join(g, "path", "full_outer")
    return j.where("action is null or action <> 'delete'").select("path", F.coalesce("g", "w").alias("hash"))


def is_clean(working: DataFrame, disk: DataFrame, staging: DataFrame) -> DataFrame:
    """One row: ``n_staged, n_changed, clean``; untracked paths do not count."""
    changed = status(working, disk, staging.limit(0)).where("state in ('modified', 'deleted')").agg(F.count("*").alias("n_changed"))
    return staging.agg(F.count("*").alias("n_staged")).crossJoin(changed).withColumn("clean", (F.col("n_staged") == 0) & (F.col("n_changed") == 0))


def checkout_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, step``: write what the new tree has otherwise, remove what only the old tree has."""
    return tree_diff(old.select("path", F.col("hash").alias("document")), new.select("path", F.col("hash").alias("document"))).select("path", F.when(F.col("status") == "removed", "remove").otherwise("write").alias("step"))


def overwrite_guard(target: DataFrame, working: DataFrame, disk: DataFrame) -> DataFrame:
    """Target paths that are on disk and not tracked with the same hash."""
    same = working.join(disk, ["path", "hash"], "left_semi").select("path")
    return target.select("path").join(disk.select("path"), "path", "left_semi").join(same, "path", "left_anti")


def revert_plan(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """``path, step``: restore the paths that the tree has, warn of the others."""
    t = tree.select("path", F.col("hash").alias("h"))
    return paths.select("path").distinct().join(t, "path", "left").select("path", F.when(F.col("h").isNotNull(), "restore").otherwise("warn").alias("step"), "h")


def history(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """``start, commit, depth``: ancestors of each start by least depth, along ``parents(commit, parent)``; each once.

    Commits with one parent form chains. Pointer doubling gives each the end of
    its chain, so a round of the walk goes from one commit with several parents to
    the next, however long the chains between; those that were entered are then
    given out by the same doubled steps, which reach every commit of a chain once.
    A straight history takes as many rounds as the logarithm of its length.
    """
    arcs = settled(parents.where("parent is not null").select("commit", "parent").distinct())
    degree = settled(arcs.groupBy("commit").agg(F.count("*").alias("n"), F.min("parent").alias("only")))
    jumps = [settled(degree.where("n = 1").select("commit", F.col("only").alias("to")))]
    ends = jumps[0].select("commit", "to", F.lit(1).cast("long").alias("steps"))
    done, active = ends.limit(0), ends
    while not active.isEmpty():
        up = active.unionByName(done).select(F.col("commit").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        moved = active.join(up, "to", "left").select("commit", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("to2").isNull().alias("over"))
        moved = settled(moved)
        done, active = done.unionByName(moved.where("over").drop("over")), moved.where("not over").drop("over")
        last = jumps[-1]
        jumps.append(settled(last.join(last.select(F.col("commit").alias("to"), F.col("to").alias("far")), "to").select("commit", F.col("far").alias("to"))))
    chain = settled(done)
    forks = settled(arcs.join(degree.where("n > 1").select("commit"), "commit", "left_semi"))
    # Entries of chains by least depth; a later but shorter way replaces a longer one and goes on.
    best = settled(starts.select(F.col("commit").alias("start"), "commit", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = best
    while True:
        stops = frontier.join(chain, "commit", "left").select("start", F.coalesce("to", "commit").alias("commit"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"))
        ahead = stops.join(forks, "commit").groupBy("start", F.col("parent").alias("commit")).agg((F.min("depth") + 1).alias("depth"))
        known = best.select("start", "commit", F.col("depth").alias("known"))
        frontier = settled(ahead.join(known, ["start", "commit"], "left").where("known is null or depth < known").select("start", "commit", "depth"))
        if frontier.isEmpty():
            break
        best = settled(best.join(frontier.select("start", "commit"), ["start", "commit"], "left_anti").unionByName(frontier))
    rows = Grown(best)
    for k, jump in enumerate(jumps):
        rows.append(rows.all().join(jump, "commit").select("start", F.col("to").alias("commit"), (F.col("depth") + 2**k).alias("depth")))
    return rows.all().groupBy("start", "commit").agg(F.min("depth").alias("depth"))


def log(starts: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """History in breadth-first order with ``position``; the first ``limit`` of each start."""
    w = Window.partitionBy("start").orderBy("depth", "commit")
    rows = history(starts, parents).withColumn("position", F.row_number().over(w))
    return rows.where(F.col("position") <= limit) if limit is not None else rows


def common_ancestors(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """``a, b, ancestor, distance`` of pairs of commits: the least sum of depths, ties by commit; no row where histories are disjoint."""
    ends = pairs.select(F.col("a").alias("commit")).union(pairs.select(F.col("b").alias("commit"))).distinct()
    h = settled(history(ends, parents))
    x = h.select(F.col("start").alias("a"), "commit", F.col("depth").alias("da"))
    y = h.select(F.col("start").alias("b"), "commit", F.col("depth").alias("db"))
    met = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "commit"])
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("distance"), "commit")).alias("m"))
    return best.select("a", "b", F.col("m.commit").alias("ancestor"), F.col("m.distance").alias("distance"))


def sync_plan(source: DataFrame, target: DataFrame, parents: DataFrame, policy: str) -> DataFrame:
    """``name, old, new, step`` of refs: create, up-to-date, fast-forward, overwrite, rejected or skipped by policy (ff-only, overwrite, reject)."""
    j = source.select("name", F.col("hash").alias("new")).join(target.select("name", F.col("hash").alias("old")), "name", "left")
    moved = j.where("old is not null and old <> new")
    found = common_ancestors(moved.select(F.col("old").alias("a"), F.col("new").alias("b")), parents)
    j = j.join(found.select(F.col("a").alias("old"), F.col("b").alias("new"), "ancestor"), ["old", "new"], "left")
    other = {"overwrite": "overwrite", "ff-only": "rejected", "reject": "rejected"}[policy]
    forward = "rejected" if policy == "reject" else "fast-forward"
    step = F.when(F.col("old").isNull(), "create").when(F.col("old") == F.col("new"), "up-to-date").when(F.col("ancestor") == F.col("old"), forward).otherwise(other)
    return j.select("name", "old", "new", step.alias("step"))


def resolve(revisions: DataFrame, refs: DataFrame) -> DataFrame:
    """``rev, hash`` of revision names: a 64-digit hash, HEAD, a full ref name, a branch, a tag, in that order; null if none."""
    out = revisions.select("rev")
    for alias, name in (("full", F.col("rev")), ("branch", F.concat(F.lit("refs/heads/"), "rev")), ("tag", F.concat(F.lit("refs/tags/"), "rev"))):
        out = out.join(refs.select(F.col("name").alias(f"{alias}_name"), F.col("hash").alias(alias)), name == F.col(f"{alias}_name"), "left")
    whole = F.when(F.col("rev").rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("sha256:"), F.lower("rev")))
    exact = F.when((F.col("rev") == "HEAD") | F.col("rev").startswith("refs/"), F.col("full"))
    return out.select("rev", F.coalesce(whole, exact, "branch", "tag").alias("hash"))


def first_document(entries: DataFrame) -> DataFrame:
    """``tree, path, document``: the first entry of each tree by path."""
    return entries.groupBy("tree").agg(F.min(F.struct("path", "document")).alias("m")).select("tree", "m.path", "m.document")


def distinct_trees(refs: DataFrame) -> DataFrame:
    """Of refs with the same tree, the first by name."""
    return refs.groupBy("tree").agg(F.min("name").alias("name"))


def json_rows(df: DataFrame, columns: list[str], name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias(name))


def has_prefix(column: Column, prefix: str) -> Column:
    return F.coalesce(column.startswith(prefix), F.lit(False))

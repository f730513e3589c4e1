"""Repository commands as operators: transactions, refs with compare-and-set, branches, tags, clone, push, pull, diffs.

A repository is a set of tables: ``objects(hash, inclusive_hash, kind, body)``,
``refs(name, hash)``, ``parents(commit, parent)`` and ``trees(tree, path, document)``.
Commands return what changes as tables; who writes them decides when.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.hashing import text_hash
from lamina.operators import versions as V
from lamina.operators.tables import settled
from lamina.operators.xmldiff import diff_documents

HEADS, TAGS, HEAD = "refs/heads/", "refs/tags/", "HEAD"
MAIN = "main"


class Transaction:
    """Objects that are put become visible together at commit, or not at all; a used transaction takes no more.

    Rows of a later put replace earlier ones of the same key, and those of the
    table at commit.
    """

    def __init__(self, table: DataFrame, key: str = "hash") -> None:
        self.table, self.key, self.state = table, key, "open"
        self.staged: list[DataFrame] = []

    def _open(self) -> None:
        if self.state != "open":
            raise RuntimeError(f"the transaction is already {self.state}")

    def put(self, rows: DataFrame) -> None:
        self._open()
        self.staged.append(rows.select(*self.table.columns))

    def commit(self) -> DataFrame:
        """The table with all that was put."""
        self._open()
        self.state = "committed"
        if not self.staged:
            return self.table
        numbered = [df.withColumn("put_", F.lit(i)) for i, df in enumerate(self.staged)]
        rows = numbered[0]
        for df in numbered[1:]:
            rows = rows.unionByName(df)
        whole = F.struct(*self.table.columns)
        last = rows.groupBy(F.col(self.key).alias("key_")).agg(F.max(F.struct("put_", whole.alias("row"))).alias("m")).select("m.row.*")
        return settled(V.upsert(self.table, last, self.key))

    def rollback(self) -> DataFrame:
        self._open()
        self.state = "rolled back"
        self.staged = []
        return self.table


def compare_and_set(refs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(refs, outcomes)`` after ``asked(name, expected, value)``: a ref moves if it holds what is expected.

    A null expectation creates only, a null value deletes. Of several requests
    for one name the least counts and the others fail, as they would one after
    the other. ``outcomes(name, expected, value, done)``.
    """
    first = asked.groupBy("name").agg(F.min(F.struct(F.col("expected").isNotNull().alias("has"), "expected", F.coalesce("value", F.lit("")).alias("v"))).alias("f"))
    j = asked.join(first, "name").join(refs.select("name", F.col("hash").alias("now")), "name", "left")
    chosen = F.col("expected").eqNullSafe(F.col("f.expected")) & (F.coalesce("value", F.lit("")) == F.col("f.v"))
    j = j.select("name", "expected", "value", (chosen & F.col("now").eqNullSafe(F.col("expected"))).alias("done"))
    moved = j.where("done").select("name", F.col("value").alias("hash")).distinct()
    kept = refs.select("name", "hash").join(moved.select("name"), "name", "left_anti")
    return kept.unionByName(moved.where("hash is not null")), j


def branches(refs: DataFrame, head: Column | str) -> DataFrame:
    """``branch, hash, current`` by name; ``head`` is the name of the ref that HEAD points to."""
    head = F.lit(head) if isinstance(head, str) else head
    own = refs.where(F.col("name").startswith(HEADS))
    return own.select(F.substring("name", len(HEADS) + 1, 1000).alias("branch"), "hash", (F.col("name") == head).alias("current")).orderBy("branch")


def delete_branches(refs: DataFrame, names: DataFrame, head: str) -> tuple[DataFrame, DataFrame]:
    """``(refs, refused)``: the current branch and unknown ones are refused, with the reason."""
    full = names.select("branch", F.concat(F.lit(HEADS), "branch").alias("name")).join(refs.select("name", "hash"), "name", "left")
    reason = F.when(F.col("hash").isNull(), "no such branch").when(F.col("name") == head, "it is checked out")
    judged = full.select("branch", "name", reason.alias("reason"))
    return refs.join(judged.where("reason is null").select("name"), "name", "left_anti"), judged.where("reason is not null").select("branch", "reason")


def tag_objects(tags: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(objects, refs)`` of annotated tags ``tags(tag, target, message)``: an object each, and a ref that holds the object's hash, not the commit's."""
    body = F.to_json(F.struct("tag", "target", F.coalesce("message", F.lit("")).alias("message")))
    made = tags.withColumn("body", body).withColumn("hash", text_hash(F.col("body")))
    objects = made.select("hash", F.col("hash").alias("inclusive_hash"), F.lit("tag").alias("kind"), "body")
    named = made.select(F.concat(F.lit(TAGS), "tag").alias("name"), "hash")
    return objects, V.upsert(refs.select("name", "hash"), named, "name")


def tag_targets(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """``tag, tag_hash, target``: what tags point to; a ref straight to a commit is its own target."""
    own = refs.where(F.col("name").startswith(TAGS)).select(F.substring("name", len(TAGS) + 1, 1000).alias("tag"), F.col("hash").alias("tag_hash"))
    held = objects.where("kind = 'tag'").select(F.col("hash").alias("tag_hash"), F.get_json_object("body", "$.target").alias("target"))
    return own.join(held, "tag_hash", "left").select("tag", "tag_hash", F.coalesce("target", "tag_hash").alias("target"))


def clone(refs: DataFrame, objects: DataFrame, prefix: str = HEADS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(refs, objects, head)`` of a new repository: heads only, all objects, and the default branch (main, else the first by name)."""
    heads = refs.where(F.col("name").startswith(prefix)).select("name", "hash")
    first = F.min(F.struct((F.col("name") != HEADS + MAIN).alias("other"), "name")).alias("m")
    head = heads.agg(first).where("m is not null").select(F.lit(HEAD).alias("name"), F.col("m.name").alias("target"))
    return heads, objects.dropDuplicates(["hash"]), head


def push(source: DataFrame, target: DataFrame, parents: DataFrame, objects: DataFrame, target_objects: DataFrame, policy: str = "ff-only") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(refs, plan, new objects)``: heads move by policy; objects are sent before, so they stay even where a ref is rejected."""
    heads = lambda df: df.where(F.col("name").startswith(HEADS)).select("name", "hash")
    plan = settled(V.sync_plan(heads(source), heads(target), parents, policy))
    moved = plan.where("step in ('create', 'fast-forward', 'overwrite')").select("name", F.col("new").alias("hash"))
    return V.upsert(target.select("name", "hash"), moved, "name"), plan, V.transfer(objects, target_objects)


def pull(refs: DataFrame, remote: DataFrame, parents: DataFrame, working: DataFrame, disk: DataFrame, staging: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(refs, plan, obstacles)``: nothing moves while the working copy is not clean or an incoming path would be overwritten.

    ``obstacles(path, reason)``; ``incoming(path, hash)`` is the tree that the
    checked-out branch would get.
    """
    states = V.status(working, disk, staging).where("state <> 'untracked'").select("path", F.col("state").alias("reason"))
    lost = V.overwrite_guard(incoming, working, disk).join(states.select("path"), "path", "left_anti").select("path", F.lit("would be overwritten").alias("reason"))
    obstacles = settled(states.unionByName(lost))
    plan = V.sync_plan(remote.where(F.col("name").startswith(HEADS)).select("name", "hash"), refs, parents, "ff-only")
    free = obstacles.agg((F.count("*") == 0).alias("free"))  # one row
    plan = settled(plan.crossJoin(F.broadcast(free)).withColumn("step", F.when(F.col("free"), F.col("step")).otherwise("blocked")).drop("free"))
    moved = plan.where("step in ('create', 'fast-forward')").select("name", F.col("new").alias("hash"))
    return V.upsert(refs.select("name", "hash"), moved, "name"), plan, obstacles


def tree_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``path, status`` between two trees ``path, hash``."""
    return V.tree_diff(a.select("path", F.col("hash").alias("document")), b.select("path", F.col("hash").alias("document"))).select("path", "status")


def diff(a: DataFrame, b: DataFrame, contents: DataFrame, quiet: bool = False) -> DataFrame:
    """``path, status, change, at, old, new``: file classes between two trees ``path, hash``, and the XML changes of modified files.

    ``contents(hash, xml)`` has both sides' texts. Added and removed files have
    one row without a change, and so have modified ones whose XML does not
    differ, unless ``quiet`` leaves those out (as between working copy and disk).
    """
    x, y = (df.select("path", F.col("hash").alias(f"h{n}")) for df, n in ((a, "a"), (b, "b")))
    classes = settled(tree_changes(a, b))
    text = lambda n: contents.select(F.col("hash").alias(f"h{n}"), F.col("xml").alias(n))
    pairs = classes.where("status = 'modified'").join(x, "path").join(y, "path").join(text("a"), "ha").join(text("b"), "hb").select("path", "a", "b")
    changes = diff_documents(pairs)
    out = classes.join(changes, "path", "left").select("path", "status", "change", "at", "old", "new")
    return out.where("status <> 'modified' or change is not null") if quiet else out

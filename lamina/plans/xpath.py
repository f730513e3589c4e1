"""An XPath subset compiled to DataFrame plans over a node table.

Paths (``/``, ``//``, ``..``, ``.``, ``*``, ``@a``, ``text()``, ``comment()``,
``node()``, the axes child, descendant, descendant-or-self, self, parent,
ancestor, following-sibling, preceding-sibling and attribute), predicates
(positions, ``last()``, ``position()``, ``count``, ``string-length``,
``normalize-space``, comparisons with =, !=, <, <=, > and >=, ``contains``,
``starts-with``, ``not``, ``and``, ``or``, paths), a bracketed path with a position,
unions at the top, and ``count(path)`` or ``string(path)`` at the
top. Names without a prefix match elements without a namespace; an unknown
prefix or a malformed text is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(//|/|\.\.|\.|::|!=|<=|>=|[@()\[\],=*|<>])|(\d+(?:\.\d+)?)|\"([^\"]*)\"|'([^']*)'|([A-Za-z_][\w.-]*(?::(?!:)[A-Za-z_*][\w.-]*)?))")
AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "attribute")
ORDER = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class XPathError(ValueError):
    """A malformed or unsupported expression."""


@dataclass
class Step:
    axis: str
    test: str
    predicates: list = field(default_factory=list)


@dataclass
class Path:
    absolute: bool
    steps: list[Step]
    inner: Path | None = None
    predicates: list = field(default_factory=list)


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise XPathError(f"unexpected text at {at}: {text[at:]!r}")
            kind = next(k for k, v in zip(("op", "num", "str", "str", "name"), m.groups(), strict=True) if v is not None)
            self.tokens.append((kind, next(v for v in m.groups() if v is not None)))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and got != value:
            raise XPathError(f"expected {value or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def top(self):
        kind, v = self.peek()
        if kind == "name" and v in ("count", "string") and self.peek(1)[1] == "(":
            self.take()
            self.take("(")
            out = (v, self.path())
            self.take(")")
        else:
            paths = [self.path()]
            while self.peek() == ("op", "|"):
                self.take()
                paths.append(self.path())
            out = ("nodes", *paths)
        if self.peek()[0] != "end":
            raise XPathError(f"text behind the end: {self.peek()[1]}")
        return out

    def path(self) -> Path:
        inner, predicates = None, []
        if self.peek()[1] == "(" and self.peek()[0] == "op":
            self.take()
            inner = self.path()
            self.take(")")
            while self.peek() == ("op", "["):
                predicates.append(self.predicate())
            steps: list[Step] = []
            if self.peek()[1] not in ("/", "//"):
                return Path(False, steps, inner, predicates)
        absolute = self.peek()[1] in ("/", "//") and inner is None
        steps = []
        if self.peek()[1] == "//":
            self.take()
            steps.append(Step("descendant-or-self", "node()"))
        elif self.peek()[1] == "/":
            self.take()
            if self.peek()[0] == "end":
                return Path(True, [])
        steps.append(self.step())
        while self.peek()[1] in ("/", "//") and self.peek()[0] == "op":
            if self.take() == "//":
                steps.append(Step("descendant-or-self", "node()"))
            steps.append(self.step())
        return Path(absolute, steps, inner, predicates)

    def step(self) -> Step:
        kind, v = self.peek()
        if v == "..":
            self.take()
            return Step("parent", "node()")
        if v == "." and kind == "op":
            self.take()
            return Step("self", "node()")
        axis = "child"
        if v == "@" and kind == "op":
            self.take()
            axis = "attribute"
        elif kind == "name" and self.peek(1)[1] == "::":
            axis = self.take()
            self.take("::")
            if axis not in AXES:
                raise XPathError(f"axis {axis} is not supported")
        kind, v = self.peek()
        if kind == "name" or v == "*" and kind == "op":
            test = self.take()
            if self.peek() == ("op", "("):
                if test not in ("text", "node", "comment"):
                    raise XPathError(f"{test}() is no node test")
                self.take()
                self.take(")")
                test += "()"
        else:
            raise XPathError(f"a step is expected, found {v or 'the end'}")
        out = Step(axis, test)
        while self.peek() == ("op", "["):
            out.predicates.append(self.predicate())
        return out

    def predicate(self):
        self.take("[")
        if self.peek()[0] == "num" and self.peek(1)[1] == "]":
            out = ("position", int(self.take()))
        elif self.peek()[1] == "last" and self.peek(1)[1] == "(" and self.peek(3)[1] == "]":
            self.take(), self.take("("), self.take(")")
            out = ("last",)
        else:
            out = self.either()
        self.take("]")
        return out

    def either(self):
        out = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.test()
        while self.peek() == ("name", "and"):
            self.take()
            out = ("and", out, self.test())
        return out

    def test(self):
        kind, v = self.peek()
        if kind == "name" and v in ("contains", "starts-with") and self.peek(1)[1] == "(":
            self.take(), self.take("(")
            path = self.path()
            self.take(",")
            if self.peek()[0] != "str":
                raise XPathError(f"{v} needs a text")
            out = (v, path, self.take())
            self.take(")")
            return out
        if kind == "name" and v == "not" and self.peek(1)[1] == "(":
            self.take(), self.take("(")
            out = ("not", self.either())
            self.take(")")
            return out
        operand = self.operand()
        if self.peek()[0] == "op" and self.peek()[1] in ORDER:
            op = self.take()
            kind = self.peek()[0]
            if kind not in ("str", "num"):
                raise XPathError("a comparison needs a text or a number")
            return ("compare", op, operand, kind, self.take())
        if operand[0] != "path":
            raise XPathError(f"{operand[0]}() needs a comparison")
        return ("exists", operand[1])

    def operand(self):
        kind, v = self.peek()
        if kind == "name" and self.peek(1)[1] == "(" and v in ("position", "count", "string-length", "normalize-space"):
            self.take(), self.take("(")
            out = (v, None if v == "position" else self.path())
            self.take(")")
            return out
        return ("path", self.path())


class Compiler:
    """Plans over ``nodes``; a context is a frame of (path, pre, ctx, value), ctx the node a predicate stands for."""

    def __init__(self, nodes: DataFrame, namespaces: dict[str, str] | None = None) -> None:
        self.nodes = nodes.where("kind <> 'error'")
        self.ns = namespaces or {}

    def name_test(self, test: str, name: Column, uri: Column) -> Column:
        if test == "*":
            return F.lit(True)
        prefix, _, local = test.rpartition(":")
        if prefix and prefix not in self.ns:
            raise XPathError(f"unknown prefix: {prefix}")
        space = uri == self.ns[prefix] if prefix else uri.isNull()
        return space if local == "*" else space & (name == local)

    def run(self, path: Path, context: DataFrame | None = None) -> DataFrame:
        """Nodes (and for attributes their values) that a path selects, with the context node they come from."""
        if path.inner is not None:
            cur = self.run(path.inner, context)
            for p in path.predicates:
                cur = self.filtered(cur, p, ["path", "ctx"] if context is not None else ["path"])
        elif path.absolute or context is None:
            start = self.nodes.where("kind = 'document'").select("path", "pre", F.lit(None).cast("string").alias("value"))
            cur = start.withColumn("ctx", F.col("pre")) if context is None else context.select("path", F.col("pre").alias("ctx")).join(start, "path").select("path", "pre", "ctx", "value")
        else:
            cur = context.select("path", "pre", F.col("pre").alias("ctx"), F.lit(None).cast("string").alias("value"))
        steps = list(path.steps)
        i = 0
        while i < len(steps):
            step = steps[i]
            # //name is one step over all descendants, not a step to every node and one to its children.
            if step.axis == "descendant-or-self" and step.test == "node()" and not step.predicates and i + 1 < len(steps) and steps[i + 1].axis == "child" and not any(p[0] in ("position", "last") for p in steps[i + 1].predicates):
                step = Step("descendant", steps[i + 1].test, steps[i + 1].predicates)
                i += 1
            cur = self.step(cur, step)
            i += 1
        return cur

    def step(self, cur: DataFrame, step: Step) -> DataFrame:
        n = self.nodes.select("path", F.col("pre").alias("n_pre"), F.col("parent_pre").alias("n_parent"), "kind", "local_name", "ns_uri", "attrs", "ancestors")
        if step.axis == "attribute":
            held = cur.join(n, (cur.path == n.path) & (cur.pre == n.n_pre)).select(cur.path, "pre", "ctx", F.explode("attrs").alias("a"))
            return self.then(held.where(self.name_test(step.test, F.col("a.local_name"), F.col("a.ns_uri"))).select("path", "pre", "ctx", F.col("pre").alias("from"), F.col("a.value").alias("value")), step)
        kinds = {"text()": F.col("kind") == "text", "comment()": F.col("kind") == "comment", "node()": F.lit(True)}
        match = kinds[step.test] if step.test in kinds else (F.col("kind") == "element") & self.name_test(step.test, F.col("local_name"), F.col("ns_uri"))
        n = n.where(match)
        none = F.lit(None).cast("string").alias("value")
        # All joins are on equal positions: whatever lies below or above a node is found by its list of ancestors.
        if step.axis in ("child", "self"):
            at = "n_parent" if step.axis == "child" else "n_pre"
            found = n.select("path", F.col("n_pre"), F.col(at).alias("pre"))
        elif step.axis in ("descendant", "descendant-or-self"):
            above = F.col("ancestors") if step.axis == "descendant" else F.concat("ancestors", F.array("n_pre"))
            found = n.select("path", "n_pre", F.explode(above).alias("pre"))
        elif step.axis.endswith("sibling"):
            own = self.nodes.select("path", "pre", F.col("parent_pre").alias("n_parent"))
            later = F.col("n_pre") > F.col("pre") if step.axis.startswith("following") else F.col("n_pre") < F.col("pre")
            found = own.join(cur.select("path", "pre").distinct(), ["path", "pre"], "left_semi").join(n.select("path", "n_pre", "n_parent"), ["path", "n_parent"]).where(later).select("path", "n_pre", "pre")
        else:
            up = F.explode(F.concat("ancestors", F.array("pre")) if step.axis == "ancestor-or-self" else F.col("ancestors")) if step.axis.startswith("ancestor") else F.col("parent_pre")
            reached = self.nodes.select("path", "pre", up.alias("n_pre"))
            found = reached.join(n.select("path", "n_pre"), ["path", "n_pre"])
        out = cur.select("path", "pre", "ctx").join(found, ["path", "pre"]).select("path", F.col("n_pre").alias("pre"), "ctx", F.col("pre").alias("from"), none)
        return self.then(out, step)

    def then(self, out: DataFrame, step: Step) -> DataFrame:
        out = out.distinct()
        for p in step.predicates:
            out = self.filtered(out, p, ["path", "ctx", "from"])
        return out.select("path", "pre", "ctx", "value").distinct()

    def filtered(self, cur: DataFrame, p: tuple, group: list[str]) -> DataFrame:
        if p[0] in ("position", "last") or p[0] == "compare" and p[2][0] == "position":
            w = Window.partitionBy(*group)
            at = F.row_number().over(w.orderBy("pre"))
            want = at == p[1] if p[0] == "position" else at == F.count("*").over(w) if p[0] == "last" else ORDER[p[1]](at, F.lit(float(p[4])))
            return cur.withColumn("_keep", want).where("_keep").drop("_keep")
        return cur.join(self.holding(cur.select("path", "pre").distinct(), p), ["path", "pre"], "left_semi")

    def holding(self, ctx: DataFrame, p: tuple) -> DataFrame:
        """The context nodes for which a condition holds."""
        if p[0] == "and":
            return self.holding(ctx, p[1]).intersect(self.holding(ctx, p[2]))
        if p[0] == "or":
            return self.holding(ctx, p[1]).union(self.holding(ctx, p[2])).distinct()
        if p[0] == "not":
            return ctx.subtract(self.holding(ctx, p[1]))
        if p[0] == "compare":
            return self.comparing(ctx, *p[1:])
        found = self.run(p[1], ctx)
        if p[0] != "exists":
            found = self.valued(found)
            v = F.col("value")
            found = found.where({"contains": v.contains(p[2]), "starts-with": v.startswith(p[2])}[p[0]])
        return found.select("path", F.col("ctx").alias("pre")).distinct()

    def comparing(self, ctx: DataFrame, op: str, operand: tuple, kind: str, literal: str) -> DataFrame:
        """The context nodes of which a number or value stands in a relation to a literal; order and numbers compare as numbers."""
        name, path = operand
        if name == "position":
            raise XPathError("position() stands alone in a predicate")
        found = self.run(path, ctx)
        if name == "count":
            n = found.groupBy("path", F.col("ctx").alias("pre")).agg(F.count("*").alias("n"))
            counted = ctx.join(n, ["path", "pre"], "left").where(ORDER[op](F.coalesce("n", F.lit(0)), F.lit(float(literal))))
            return counted.select("path", "pre")
        v = self.valued(found).withColumn("v", F.col("value"))
        if name == "normalize-space":
            v = v.withColumn("v", F.trim(F.regexp_replace("value", r"\s+", " ")))
        elif name == "string-length":
            v = v.withColumn("v", F.length("value").cast("string"))
        numbers = kind == "num" or op not in ("=", "!=") or name == "string-length"
        left = F.expr("try_cast(trim(v) as double)") if numbers else F.col("v")
        return v.where(ORDER[op](left, F.lit(float(literal) if numbers else literal))).select("path", F.col("ctx").alias("pre")).distinct()

    def valued(self, found: DataFrame) -> DataFrame:
        """String values: of attributes, of leaves, and of elements the text below them in order."""
        missing = found.where("value is null").select("path", "pre").distinct()
        leaf = self.nodes.where("kind in ('text', 'comment')")
        above = F.explode(F.when(F.col("kind") == "text", F.concat("ancestors", F.array("pre"))).otherwise(F.array("pre")))
        below = leaf.select("path", F.col("pre").alias("t_pre"), "text", above.alias("pre")).join(missing, ["path", "pre"])
        text = below.groupBy("path", "pre").agg(F.array_sort(F.collect_list(F.struct("t_pre", "text"))).alias("t")).select("path", "pre", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("s"))
        return found.join(text, ["path", "pre"], "left").withColumn("value", F.coalesce("value", "s", F.lit(""))).drop("s")


def evaluate(nodes: DataFrame, xpath: str, mode: str = "text", namespaces: dict[str, str] | None = None) -> DataFrame:
    """Results of a query per document: mode ``count`` gives ``path, n``, ``text`` gives ``path, pre, value`` (trimmed), ``ids`` the ids of elements and the values of attributes."""
    if mode not in ("count", "text", "ids"):
        raise ValueError(f"invalid query mode: {mode}")
    kind, *paths = Parser(xpath).top()
    c = Compiler(nodes, namespaces)
    found = c.run(paths[0])
    for other in paths[1:]:
        found = found.union(c.run(other)).distinct()
    if kind == "count" or mode == "count":
        return found.groupBy("path").agg(F.count("*").cast("long").alias("n"))
    if mode == "ids":
        named = found.join(c.nodes.select("path", "pre", "id"), ["path", "pre"], "left")
        return named.select(F.coalesce("value", "id").alias("id")).where("id <> ''").distinct()
    out = c.valued(found)
    if kind == "string":
        first = out.groupBy("path").agg(F.min_by("value", "pre").alias("value"))
        return first.select("path", F.lit(0).cast("long").alias("pre"), F.trim("value").alias("value"))
    return out.select("path", "pre", F.trim("value").alias("value"))

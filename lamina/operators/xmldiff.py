"""Structural diff and three-way merge of XML documents, one document a task's unit of work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lamina.sources.xml import XML_NS, Node, deep, digest, parse, serialise


def child_keys(node: Node, xml_ids: bool = False) -> list[tuple]:
    """A key per child: name and id, or name and how many like it stand before; leaves by kind and count."""
    seen: dict[tuple, int] = {}
    out = []
    for c in node.children:
        if c.kind == "element":
            own = next((v for a, u, _, v in c.attrs if a == "id" and (u is None or xml_ids and u == XML_NS)), None)
            name = ("element", c.name) if xml_ids else ("element", c.uri, c.name)
            if own is not None:
                out.append((*name, "id", own))
                continue
        else:
            name = (c.kind,)
        seen[name] = seen.get(name, -1) + 1
        out.append((*name, "n", seen[name]))
    return out


def segment(node: Node, siblings: list[Node]) -> str:
    own = next((v for a, u, _, v in node.attrs if a == "id" and u is None), None)
    if own is not None:
        return f'{node.name}[@id="{own}"]'
    same = [s for s in siblings if s.kind == "element" and s.name == node.name]
    return f"{node.name}[{next(i for i, s in enumerate(same) if s is node) + 1}]" if len(same) > 1 else node.name


def diff(a: Node, b: Node, path: str = "") -> list[tuple[str, str, str | None, str | None]]:
    """(change, path, old, new) of two elements with the same key; equal hashes end the walk."""
    out: list[tuple[str, str, str | None, str | None]] = []
    x = {(n, u): v for n, u, _, v in a.attrs}
    y = {(n, u): v for n, u, _, v in b.attrs}
    for k in [*x, *(k for k in y if k not in x)]:
        if x.get(k) != y.get(k):
            kind = "attribute-added" if k not in x else "attribute-removed" if k not in y else "attribute-changed"
            out.append((kind, f"{path}/@{k[0]}", x.get(k), y.get(k)))
    left, right = dict(zip(child_keys(a), a.children, strict=True)), dict(zip(child_keys(b), b.children, strict=True))
    for k in [*left, *(k for k in right if k not in left)]:
        m, n = left.get(k), right.get(k)
        one = m or n
        here = f"{path}/{segment(one, (a if m else b).children)}" if one.kind == "element" else f"{path}/{one.kind}()"
        if m is None or n is None:
            if one.kind == "text" and not one.text.strip():
                continue
            out.append((f"{one.kind}-{'removed' if n is None else 'added'}", here, m.text if m and m.kind != "element" else None, n.text if n and n.kind != "element" else None))
        elif m.kind == "element":
            if digest(m, False) != digest(n, False) or _comments(m) != _comments(n):
                out += diff(m, n, here)
        elif m.text != n.text:
            out.append((f"{m.kind}-changed", here, m.text, n.text))
    return out


def _comments(n: Node) -> list[str]:
    return [c.text for c in n.children if c.kind == "comment"] + [t for c in n.children if c.kind == "element" for t in _comments(c)]


def merge(a: Node | None, o: Node, t: Node, path: str, conflicts: list[str]) -> Node:
    """Three-way merge of elements with the same key; conflicts are noted by path, and ours stands there."""
    if digest(o) == digest(t) or a is not None and digest(t) == digest(a):
        return o
    if a is not None and digest(o) == digest(a):
        return t
    sides = [{(n, u): (n, u, p, v) for n, u, p, v in x.attrs} if x is not None else {} for x in (a, o, t)]
    attrs, clash = [], False
    for k in dict.fromkeys([*sides[1], *sides[2], *sides[0]]):
        va, vo, vt = (s[k][3] if k in s else None for s in sides)
        if vo == vt or vt == va:
            chosen = sides[1].get(k)
        elif vo == va:
            chosen = sides[2].get(k)
        else:
            clash, chosen = True, sides[1].get(k)
        if chosen:
            attrs.append(chosen)
    if clash:
        conflicts.append(path or "/")
        return o
    keyed = [dict(zip(child_keys(x, True), x.children, strict=True)) if x is not None else {} for x in (a, o, t)]
    children = []
    for k in [*keyed[1], *(k for k in keyed[2] if k not in keyed[1])]:
        ca, co, ct = (s.get(k) for s in keyed)
        here = f"{path}/{(co or ct).name or (co or ct).kind}"
        same = lambda x, y: x is not None and y is not None and x.kind == y.kind and (digest(x) == digest(y) if x.kind == "element" else x.text == y.text)
        if co is not None and ct is not None:
            if co.kind == "element":
                children.append(merge(ca, co, ct, here, conflicts))
            elif same(co, ct) or same(ct, ca):
                children.append(co)
            elif same(co, ca):
                children.append(ct)
            else:
                conflicts.append(here)
                children.append(co)
        elif ca is None:
            children.append(co or ct)
        elif not same(co or ct, ca):  # changed on one side, deleted on the other
            conflicts.append(here)
            children.append(co or ca)
    return Node("element", o.name, o.uri, o.prefix, attrs, o.declared, children=children)


def root_of(content: str) -> Node:
    deep(content)
    return next(c for c in parse(content).children if c.kind == "element")


def diff_documents(pairs: DataFrame) -> DataFrame:
    """``path, change, at, old, new`` of ``pairs(path, a, b)``; a pair with an ill-formed side is one row of change ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, a, b in zip(pdf["path"], pdf["a"], pdf["b"], strict=True):
                try:
                    x, y = root_of(a), root_of(b)
                    rows += [(path, *r) for r in diff(x, y, f"/{x.name}")]
                except Exception as e:  # noqa: BLE001 - the document is at fault, not the job
                    rows.append((path, "error", "", None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "change", "at", "old", "new"])

    return pairs.select("path", "a", "b").mapInPandas(run, "path string, change string, at string, old string, new string")


def merge_documents(triples: DataFrame) -> DataFrame:
    """``path, xml, conflicts, error`` of ``triples(path, a, o, t)``; a null ancestor counts as an empty one, an ill-formed side is an error of its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, a, o, t in zip(pdf["path"], pdf["a"], pdf["o"], pdf["t"], strict=True):
                notes: list[str] = []
                try:
                    merged = merge(root_of(a) if a else None, root_of(o), root_of(t), "", notes)
                    rows.append((path, serialise(merged), notes, None))
                except Exception as e:  # noqa: BLE001 - the document is at fault, not the job
                    rows.append((path, None, [], str(e)))
            yield pd.DataFrame(rows, columns=["path", "xml", "conflicts", "error"])

    return triples.select("path", "a", "o", "t").mapInPandas(run, "path string, xml string, conflicts array<string>, error string")

"""XML documents as node tables: shredding, canonical form, hashes, serialisation.

One document is one task's work; documents are independent. Positions follow the
pre-order: a node's descendants are those with ``pre < p <= last``.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XML_NS = "http://www.w3.org/XML/1998/namespace"
NODES = (
    "path string, pre long, post long, last long, parent_pre long, level int, ord int, kind string, local_name string, ns_uri string, prefix string, "
    "attrs array<struct<local_name:string,ns_uri:string,prefix:string,value:string>>, id string, xml_id string, text string, "
    "ancestors array<bigint>, ancestor_ids array<string>, ancestor_names array<string>, line_start int, line_end int, hash string, inclusive_hash string"
)


@dataclass
class Node:
    kind: str
    name: str = ""
    uri: str | None = None
    prefix: str | None = None
    attrs: list[tuple[str, str | None, str | None, str]] = field(default_factory=list)
    declared: list[tuple[str, str]] = field(default_factory=list)
    text: str = ""
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    line: int = 0
    end: int = 0
    pre: int = 0
    post: int = 0


def parse(content: str | bytes) -> Node:
    """The document as a tree; raises ``ExpatError`` where it is not well-formed. External entities are not read."""
    root = Node("document")
    stack = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    scopes: list[dict[str, str]] = [{"xml": XML_NS, "": ""}]

    def split(name: str, attribute: bool) -> tuple[str, str | None, str | None]:
        prefix, _, local = name.rpartition(":")
        if not prefix:
            return local, (None if attribute else scopes[-1][""] or None), None
        if prefix not in scopes[-1]:
            raise expat.ExpatError(f"unbound prefix: {prefix}")
        return local, scopes[-1][prefix], prefix

    def start(name: str, attrs: list[str]) -> None:
        pairs = list(zip(attrs[::2], attrs[1::2], strict=True))
        declared = [("" if k == "xmlns" else k[6:], v) for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")]
        scopes.append({**scopes[-1], **dict(declared)})
        local, uri, prefix = split(name, False)
        node = Node("element", local, uri, prefix, [(*split(k, True), v) for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")], declared, parent=stack[-1], line=parser.CurrentLineNumber)
        stack[-1].children.append(node)
        stack.append(node)

    def end(_: str) -> None:
        scopes.pop()
        stack.pop().end = parser.CurrentLineNumber

    def leaf(kind: str, text: str, name: str = "") -> None:
        if kind == "text" and stack[-1].kind == "document":
            return
        last = stack[-1].children[-1] if stack[-1].children else None
        if kind == "text" and last is not None and last.kind == "text":
            last.text += text
        else:
            stack[-1].children.append(Node(kind, name, text=text, parent=stack[-1], line=parser.CurrentLineNumber, end=parser.CurrentLineNumber))

    parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: leaf("text", s)
    parser.CommentHandler = lambda s: leaf("comment", s)
    parser.ProcessingInstructionHandler = lambda target, data: leaf("pi", data, target)
    parser.Parse(content, True)
    clock = [0, 0]
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            node.post, clock[1] = clock[1], clock[1] + 1
            continue
        node.pre, clock[0] = clock[0], clock[0] + 1
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    return root


def _escape(s: str, attribute: bool) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;")
    if attribute:
        return s.replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")
    return s.replace(">", "&gt;").replace("\r", "&#xD;")


def in_scope(node: Node) -> dict[str, str]:
    held: dict[str, str] = {}
    at: Node | None = node
    while at is not None:
        for p, u in at.declared:
            held.setdefault(p, u)
        at = at.parent
    return held


def canonical(node: Node, exclusive: bool = False, comments: bool = False, extra: dict[str, str] | None = None) -> str:
    """Canonical XML 1.0 of a subtree; ``extra`` are namespaces in scope from outside."""
    out: list[str] = []

    def write(n: Node, shown: dict[str, str], scope: dict[str, str]) -> None:
        if n.kind == "text":
            out.append(_escape(n.text, False))
        elif n.kind == "comment":
            if comments:
                out.append(f"<!--{n.text}-->")
        elif n.kind == "pi":
            out.append(f"<?{n.name}{' ' + n.text if n.text else ''}?>")
        elif n.kind == "document":
            for c in n.children:
                write(c, shown, scope)
        else:
            scope = {**scope, **dict(n.declared)}
            used = {n.prefix or ""} | {p for _, _, p, _ in n.attrs if p}
            wanted = {p: u for p, u in scope.items() if p != "xml" and (not exclusive or p in used)}
            new = {p: u for p, u in wanted.items() if shown.get(p, "") != u}
            shown = {**shown, **new}
            tag = f"{n.prefix}:{n.name}" if n.prefix else n.name
            out.append(f"<{tag}")
            for p in sorted(new):
                out.append(f' xmlns{":" + p if p else ""}="{_escape(new[p], True)}"')
            for local, _, p, v in sorted(n.attrs, key=lambda a: (a[1] or "", a[0])):
                out.append(f' {p + ":" if p else ""}{local}="{_escape(v, True)}"')
            out.append(">")
            for c in n.children:
                write(c, shown, scope)
            out.append(f"</{tag}>")

    scope = {**(extra or {}), **(in_scope(node.parent) if node.parent is not None else {})}
    write(node, {}, scope)
    return "".join(out)


def digest(node: Node, exclusive: bool = True) -> str:
    return "sha256:" + hashlib.sha256(canonical(node, exclusive).encode()).hexdigest()


def string_value(node: Node) -> str:
    if node.kind not in ("element", "document"):
        return node.text
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.kind == "text":
            out.append(n.text)
        elif n.kind in ("element", "document"):
            todo.extend(reversed(n.children))
    return "".join(out)


def deep(content: str) -> None:
    """Let calls nest as deep as a document may: an element's start takes at least three characters."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 3 * content.count("<")))


def rows_of(path: str, content: str | None, hashes: bool = True) -> list[dict]:
    """Node rows of a document in document order; one row of kind ``error`` where it is not well-formed."""
    try:
        root = parse(content or "")
    except (expat.ExpatError, ValueError) as e:
        return [{"path": path, "pre": 0, "kind": "error", "text": str(e), "attrs": [], "ancestors": [], "ancestor_ids": [], "ancestor_names": []}]
    deep(content or "")
    out: list[dict] = []
    todo: list[tuple[Node, int, int, list[int], list[str], list[str]]] = [(root, 0, 0, [], [], [])]
    while todo:
        n, level, ord_, above, ids, names = todo.pop()
        attrs = [{"local_name": a, "ns_uri": u, "prefix": p, "value": v} for a, u, p, v in n.attrs]
        own = next((v for a, u, p, v in n.attrs if a == "id" and u is None), None)
        xml_id = next((v for a, u, p, v in n.attrs if a == "id" and u == XML_NS), None)
        out.append({
            "path": path, "pre": n.pre, "post": n.post, "last": n.pre, "parent_pre": above[-1] if above else None, "level": level, "ord": ord_, "kind": n.kind, "local_name": n.name or None, "ns_uri": n.uri, "prefix": n.prefix,
            "attrs": attrs, "id": own, "xml_id": xml_id, "text": n.text if n.kind in ("text", "comment", "pi") else None, "ancestors": above, "ancestor_ids": ids, "ancestor_names": names, "line_start": n.line, "line_end": n.end,
            "hash": digest(n) if hashes and n.kind == "element" else None, "inclusive_hash": digest(n, False) if hashes and n.kind == "element" else None,
        })
        inner = ([*above, n.pre], [*ids, own or xml_id] if own or xml_id else ids, [*names, n.name] if n.kind == "element" else names)
        todo.extend((c, level + 1, i, *inner) for i, c in reversed(list(enumerate(n.children))))
    for row in reversed(out):  # positions are those of the list
        if row["parent_pre"] is not None:
            up = out[row["parent_pre"]]
            up["last"] = max(up["last"], row["last"])
    return out


def shred(files: DataFrame, hashes: bool = True) -> DataFrame:
    """The node table of ``files(path, content)``."""
    attr = pa.struct([(k, pa.string()) for k in ("local_name", "ns_uri", "prefix", "value")])
    long, text = ("pre", "post", "last", "parent_pre"), ("ancestor_ids", "ancestor_names")
    kinds = {"ancestors": pa.list_(pa.int64()), **dict.fromkeys(long, pa.int64()), **dict.fromkeys(("level", "ord", "line_start", "line_end"), pa.int32()), **dict.fromkeys(text, pa.list_(pa.string())), "attrs": pa.list_(attr)}
    names = "path pre post last parent_pre level ord kind local_name ns_uri prefix attrs id xml_id text ancestors ancestor_ids ancestor_names line_start line_end hash inclusive_hash".split()
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(rows_of(path, content, hashes), schema)

    return files.select("path", "content").mapInArrow(run, NODES)


def well_formed(nodes: DataFrame) -> DataFrame:
    """``path, error`` of the documents that are not."""
    return nodes.where("kind = 'error'").select("path", F.col("text").alias("error"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """``path, content`` of all files of a folder and its sub-folders."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def assemble(nodes: DataFrame) -> DataFrame:
    """One tree of all files: the children of every root element, roots and what stands around them dropped; ``gpre`` orders by path, then position."""
    return nodes.where("level >= 2 and kind <> 'error'").withColumn("gpre", F.struct("path", "pre"))


def serialise(node: Node) -> str:
    """XML text of a subtree with the declarations it needs; elements without a namespace undo a default one."""
    out: list[str] = []

    def write(n: Node, shown: dict[str, str]) -> None:
        if n.kind == "text":
            out.append(_escape(n.text, False))
        elif n.kind == "comment":
            out.append(f"<!--{n.text}-->")
        elif n.kind == "pi":
            out.append(f"<?{n.name}{' ' + n.text if n.text else ''}?>")
        else:
            need = {n.prefix or "": n.uri or ""} | {p: u or "" for _, u, p, _ in n.attrs if p and p != "xml"}
            new = {p: u for p, u in {**dict(n.declared), **need}.items() if p != "xml" and shown.get(p, "") != u}
            shown = {**shown, **new}
            tag = f"{n.prefix}:{n.name}" if n.prefix else n.name
            head = "".join(f' xmlns{":" + p if p else ""}="{_escape(u, True)}"' for p, u in sorted(new.items())) + "".join(f' {p + ":" if p else ""}{a}="{_escape(v, True)}"' for a, _, p, v in n.attrs)
            out.append(f"<{tag}{head}>" if n.children else f"<{tag}{head}/>")
            for c in n.children:
                write(c, shown)
            if n.children:
                out.append(f"</{tag}>")

    write(node, {})
    return "".join(out)


def export(nodes: DataFrame) -> DataFrame:
    """``path, xml``: each document rebuilt from its rows, with a declaration, what stands before the root, and a final newline."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, Node] = {}
        for r in pdf.sort_values("pre").itertuples(index=False):
            attrs = [(a["local_name"], a["ns_uri"], a["prefix"], a["value"]) for a in (r.attrs if r.attrs is not None else [])]
            none = lambda v: None if v is None or v != v else v
            node = Node(r.kind, none(r.local_name) or "", none(r.ns_uri), none(r.prefix), attrs, text=none(r.text) or "")
            by[int(r.pre)] = node
            if r.pre:
                by[int(r.parent_pre)].children.append(node)
        parts = []
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 3 * len(by)))
        for c in by[0].children:
            parts.append(serialise(c))
            if c.kind == "element":
                break
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "xml": ['<?xml version="1.0" encoding="UTF-8"?>\n' + "\n".join(parts) + "\n"]})

    return nodes.where("kind <> 'error'").select("path", "pre", "parent_pre", "kind", "local_name", "ns_uri", "prefix", "attrs", "text").groupBy("path").applyInPandas(build, "path string, xml string")

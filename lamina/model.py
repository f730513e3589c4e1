"""A folder of layered XML files as one model: validate, drift, coverage, connectivity, path queries, chunks and search.

    from lamina.model import SpecModel, Vocabulary
    m = SpecModel(spark, "specs", Vocabulary(spec="urn:s", index="urn:i", relation="urn:r", mapping="urn:m"))
    m.validate().show()
    m.query("//t:term[@id='x']", namespaces={"t": "urn:t"}).show()

Every method returns a DataFrame; the node table is made once per model.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import hashing as H
from lamina.functions import text as T
from lamina.operators import coverage as C
from lamina.operators import graph as G
from lamina.operators.reports import relation_lists
from lamina.operators.tables import settled
from lamina.plans.xpath import evaluate
from lamina.sources import specs as S
from lamina.sources import xml as X


@dataclass(frozen=True)
class Vocabulary:
    """Namespaces of the elements that a model reads."""

    spec: str
    index: str
    relation: str
    mapping: str


def find_schema_dir(start: str | Path, names: tuple[str, ...] = ("schemas", ".layers/schemas")) -> Path | None:
    """The first of ``names`` that is a folder in ``start`` or the nearest folder above it."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in names:
            if (folder / name).is_dir():
                return folder / name
    return None


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of any layout (one object, or an array of them) as rows."""
    return spark.read.option("multiLine", True).json(path)


def settings(path: str | Path, defaults: dict | None = None) -> dict:
    """A JSON settings file over defaults; a missing file gives the defaults."""
    at = Path(path)
    return {**(defaults or {}), **(json.loads(at.read_text()) if at.exists() else {})}


class SpecModel:
    def __init__(self, spark: SparkSession, folder: str, words: Vocabulary, pattern: str = "*.xml") -> None:
        self.spark, self.folder, self.words = spark, folder.rstrip("/"), words
        files = X.read_files(spark, folder, pattern)
        # Paths are told from the folder on, so that results do not depend on where it lies.
        root = F.lit("/" + self.folder.split("://")[-1].lstrip("/") + "/")
        rest = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        self.files = files.select(F.when(rest.startswith(root), F.substring(rest, F.length(root) + 1, F.length(rest))).otherwise(rest).alias("path"), "content")

    @cached_property
    def nodes(self) -> DataFrame:
        return settled(X.shred(self.files))

    @cached_property
    def index(self) -> DataFrame:
        return S.index_files(self.nodes, self.words.spec, self.words.index)

    def spec_files(self) -> DataFrame:
        """``index, ord, path`` of the files that index files list."""
        return S.spec_files(self.nodes, self.index, self.words.index)

    def ids(self) -> DataFrame:
        """``id, tag, path``: elements with an id."""
        named = F.coalesce("id", "xml_id")
        return self.nodes.where("kind = 'element'").select(named.alias("id"), F.col("local_name").alias("tag"), "path").where("id is not null")

    def relations(self) -> DataFrame:
        return S.relations(self.nodes, self.words.relation)

    def mappings(self) -> DataFrame:
        return S.mappings(self.nodes, self.words.mapping)

    def validate(self) -> DataFrame:
        """``path, rule, detail`` of everything wrong."""
        return S.validate(self.nodes, self.relations(), self.index)

    def query(self, xpath: str, mode: str = "text", namespaces: dict[str, str] | None = None) -> DataFrame:
        return evaluate(self.nodes, xpath, mode, namespaces)

    def drift(self, artifacts: DataFrame) -> DataFrame:
        """``id, status`` of each mapping against ``artifacts(path, content)``: node hashes and range hashes are taken anew."""
        m = self.mappings()
        now = self.nodes.where("kind = 'element'").select(F.coalesce("id", "xml_id").alias("node"), "path", "pre", "hash").where("node is not null")
        first = now.groupBy("node").agg(F.min_by("hash", F.struct("path", "pre")).alias("hash"))
        ranges = m.select("id", "artifact_path", F.posexplode("ranges").alias("ord", "r")).select("id", "ord", F.col("artifact_path").alias("path"), F.col("r.hash").alias("hash"), F.col("r.start_line").alias("a"), F.col("r.end_line").alias("b"))
        # A range's own text is hashed; the key of a range is its file and its lines.
        key = lambda p: F.concat_ws(":", p, F.coalesce(F.col("a").cast("string"), F.lit("")), F.coalesce(F.col("b").cast("string"), F.lit("")))
        asked = ranges.select("path", "a", "b").distinct().join(artifacts.select("path", "content"), "path")
        part = F.when(F.col("a").isNull() | F.col("b").isNull(), H.file_hash(F.col("content"))).otherwise(H.text_hash(T.line_range(F.col("content"), F.col("a").cast("int"), F.col("b").cast("int"))))
        hashes = asked.select(key(F.col("path")).alias("path"), part.alias("hash"))
        return C.drift(m.select("id", "node", "node_hash"), first, ranges.select("id", "ord", key(F.col("path")).alias("path"), "hash"), hashes)

    def coverage(self, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(files, runs)``: ``path, n_filled, n_covered, percent`` of mapped artifacts, and their uncovered runs of lines."""
        ranges = self.mappings().select(F.col("artifact_path").alias("path"), F.explode("ranges").alias("r")).select("path", "r.start_line", "r.end_line")
        lines = settled(C.covered_lines(artifacts.select("path", "content"), ranges))
        return C.file_coverage(lines), C.uncovered_runs(lines)

    def node_coverage(self, exempt: DataFrame | None = None) -> DataFrame:
        """One row: ``total, mapped, exempt, unmapped`` ids."""
        ids = self.ids().select("id")
        return C.node_coverage(ids, self.mappings().select(F.col("node").alias("id")).where("id is not null"), exempt if exempt is not None else ids.limit(0))

    def connectivity(self) -> dict[str, DataFrame]:
        """Density, edge types, degrees, components, cycles and dangling ends of the relation graph."""
        n, e = self.ids().select("id", "tag").dropDuplicates(["id"]), self.relations()
        return {"density": G.density(n, e), "types": G.type_counts(e), "degrees": G.degrees(n, e), "components": G.component_sizes(n, e), "cycles": G.cycles(n, e), "dangling": G.dangling(n, e)}

    def chunks(self, layer: Column | None = None) -> DataFrame:
        """``id, path, layer, line_start, line_end, outgoing, incoming, text``: a chunk per id.

        The span of an id is that of its first element in the last file that
        holds it; its text has a header with layer and path. Relation types out
        and in are sorted, each once.
        """
        named = self.nodes.where("kind = 'element'").withColumn("own", F.coalesce("id", "xml_id")).where("own is not null")
        last = named.groupBy("own").agg(F.max(F.struct("path", (-F.col("pre")).alias("minus"))).alias("m")).select(F.col("own").alias("o"), F.col("m.path").alias("p"), (-F.col("m.minus")).alias("at"))
        chosen = named.join(last, (named.own == F.col("o")) & (named.path == F.col("p")) & (named.pre == F.col("at"))).select("path", "pre", F.col("own").alias("id"), "ns_uri", "local_name", "ancestor_names", "line_start", "line_end")
        leaves = self.nodes.where("kind = 'text'").select("path", F.col("pre").alias("t_pre"), "text", F.explode("ancestors").alias("pre"))
        text = leaves.join(chosen.select("path", "pre"), ["path", "pre"]).groupBy("path", "pre").agg(F.array_sort(F.collect_list(F.struct("t_pre", "text"))).alias("t")).select("path", "pre", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("body"))
        lists = relation_lists(chosen.select("id"), self.relations())
        out = chosen.join(text, ["path", "pre"], "left").join(lists, "id")
        layer = T.layer_of(F.col("ns_uri")) if layer is None else layer
        return out.select("id", "path", layer.alias("layer"), "line_start", "line_end", "outgoing", "incoming", T.chunk_text(layer, F.concat("ancestor_names", F.array("local_name")), F.coalesce("body", F.lit(""))).alias("text"))

    def report(self, artifacts: DataFrame) -> DataFrame:
        """``id, node, path, status, fragment``: each mapping's drift with its lines of code, numbered, for a page to show."""
        listed = self.mappings().select("id", "node", F.col("artifact_path").alias("path"), F.posexplode_outer("ranges").alias("ord", "r"))
        code = listed.join(artifacts.select("path", "content"), "path", "left").select("id", "node", "path", "ord", fragment(F.col("content"), F.col("r.start_line"), F.col("r.end_line")).alias("fragment"))
        return code.join(self.drift(artifacts), "id", "left").select("id", "node", "path", "ord", "status", "fragment")


def fragment(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (all, if one is missing), each behind its right-aligned number of five places and a bar."""
    numbered = F.transform(T.lines(content), lambda s, i: F.struct((i + 1).alias("n"), s.alias("s")))
    chosen = F.filter(numbered, lambda x: start.isNull() | end.isNull() | ((x["n"] >= start) & (x["n"] <= end)))
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lpad(x["n"].cast("string"), 5, " "), F.lit(" | "), x["s"])), "\n")

"""Personal data: fixed patterns, and bootstrapped contextual extraction (free style: Arrow batches, DataFrame iteration).

Matches of four fixed patterns are the seed entities. What stands around them
induces lexical patterns: the two words before, the word before with the word
behind, the word before with the shape of the entity, the shape. Every other token that
looks like an identifier is a candidate instance of the patterns it stands in.
On the graph of patterns and instances (distinct values), a pattern's confidence
is the sum of the scores of its accepted instances (seeds count one) over all its
instances, shrunk for few; it is confident from ``MIN_CONFIDENCE`` on, if enough
accepted values support it. A candidate in two confident patterns or more is
accepted; its score is the chance that one of them is right. Accepted values
support further patterns in the next round, until none is added. Occurrences of
accepted values in a confident pattern are found spans of kind ``context``.

Null and empty texts have no span. Rows are told apart by a number of their own,
so repeated ids, null ids and repeated rows keep their own spans. Texts are
scanned whole, in time linear in their length; offsets count code points, ends
are exclusive. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import ship, small_batches, written

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
TRIM = ".,;:!?\"'()[]{}<>*#%&$|"
#: Distinct accepted values a confident pattern needs, its confidence, and how many such patterns a candidate needs.
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
MIN_PATTERNS = 2
#: Rounds of scoring at most.
ROUNDS = 10
#: Instances of unknown worth that are added to every pattern.
SHRINK = 1.0
MIN_CHARS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` backwards: linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(value: str) -> str:
    """Runs of digits, letters and other characters, each run once."""
    return re.sub(r"(9)9+|(a)a+", r"\1\2", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", value)))[:24]


def word(token: str) -> str:
    return re.sub(r"[0-9]", "0", token.strip(TRIM).lower())


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates with the patterns they stand in."""
    slots = [(a, b, kind) for kind, a, b in base]
    covered = sorted((a, b) for _, a, b in base)
    k = 0
    for m in re.finditer(r"\S*[0-9]\S*", text) if base or any(c in text for c in "0123456789") else ():
        a, b = m.span()
        while a < b and text[a] in TRIM:
            a += 1
        while b > a and text[b - 1] in TRIM:
            b -= 1
        if b - a < MIN_CHARS or not any(c.isdigit() for c in text[a:b]):
            continue
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k < len(covered) and covered[k][0] < b:
            continue
        slots.append((a, b, -1))
    out = []
    for a, b, kind in slots:
        left = [word(t) for t in text[max(0, a - 120) : a].split()[-2:]]
        after = TOKEN.search(text, b, min(len(text), b + 120))
        right = word(after.group()) if after else ""
        near = left[-1] if left else ""
        patterns = [f"T|{shape(text[a:b])}"]
        if len(left) == 2 and near:
            patterns.append(f"L|{left[0]} {near}")
        if near and right:
            patterns.append(f"S|{near}|{right}")
        if near:
            patterns.append(f"F|{near}|{shape(text[a:b])}")
        out.append({"start": a, "end": b, "kind": kind, "value": text[a:b].lower(), "patterns": patterns})
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    inst = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
    digit = re.compile("[0-9@]")
    K.frugal()
    for batch in batches:
        for lo, hi in K.slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            spans, found = [], []
            for text in part.column("text").to_pylist():
                if not text or not digit.search(text):
                    spans.append([])
                    found.append([])
                    continue
                base = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                found.append(instances(text, base))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, span), pa.array(found, inst)], names=["doc_id", "base", "instances"])


def confident(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (``pattern, confidence``) and accepted instances (``value, score``) of a graph ``pattern, value, seed``."""
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = written(edges.where("seed").select("value", F.lit(1.0).alias("score")).distinct())
    accepted, n_before = seeds, -1
    patterns = None
    for _ in range(rounds):
        n = accepted.count()
        if n == n_before and patterns is not None:
            break
        n_before = n
        support = edges.join(accepted, "value").groupBy("pattern").agg(F.sum("score").alias("s"), F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT)
        scored = support.join(sizes, "pattern").select("pattern", (F.col("s") / (F.col("n") + SHRINK)).alias("confidence"))
        patterns = written(scored.where(F.col("confidence") >= MIN_CONFIDENCE))
        miss = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        found = edges.where("not seed").join(patterns, "pattern").groupBy("value").agg(F.count("*").alias("k"), (1 - F.exp(miss)).alias("score"))
        accepted = written(seeds.unionByName(found.where(F.col("k") >= MIN_PATTERNS).select("value", "score").join(seeds.select("value"), "value", "left_anti")))
    return patterns, accepted


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, base, extra`` of every row: arrays of (kind, start, end)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, base array<struct<kind:int,start:int,end:int>>, instances array<struct<start:int,end:int,kind:int,value:string,patterns:array<string>>>"
    rows = written(texts.mapInArrow(_extract, schema).withColumn("row", F.monotonically_increasing_id()))
    slots = rows.where(F.size("instances") > 0).select("row", F.explode("instances").alias("i")).select("row", F.col("i.start").alias("start"), F.col("i.end").alias("end"), (F.col("i.kind") >= 0).alias("seed"), F.col("i.value").alias("value"), F.col("i.patterns").alias("patterns"))
    edges = written(slots.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    patterns, accepted = confident(edges)
    free = slots.where(~F.col("seed")).select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
    hits = free.join(patterns, "pattern", "left_semi").join(accepted, "value", "left_semi")
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit(KINDS.index("context")).alias("kind"), "start", "end"))).alias("extra"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("row", "doc_id", "base").join(found, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    spans = extract(docs)
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_context"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


ship(__name__)

"""Toxic spans and document scores from a linear-chain conditional random field (free style: Arrow batches).

Training takes a bounded sample of labelled documents (``MAX_TRAIN`` per class,
none longer than ``MAX_TRAIN_CHARS``; both are parameters). Document labels
become token labels: a word form or word start that far more toxic documents hold than chance
would give (copies count once) labels its tokens toxic. A two-state chain is
fitted to those sequences by penalised conditional likelihood. For every whole
text, forward-backward gives each token's marginal; their sum, density and
maximum give a document score through a logistic fit on the sample, and tokens
above one half are the offending spans (code point offsets).

Labels, language, source and id are no inputs of a score. Null and empty texts
have no token and get the score of a text without evidence. Repeated rows are
scored each; an id that is labelled twice counts as toxic if one label says so,
and of an id's several texts the least one is learnt from.
Without labelled rows of both classes every score is the share of toxic labels.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import ship, small_batches, unused

MAX_TRAIN = 1800
MAX_TRAIN_CHARS = 20_000
#: Lengths of the word starts that are features beside the whole form.
STARTS = (4, 5, 6, 7, 8)
#: A feature labels tokens if its share of toxic documents would be this unlikely by chance.
MAX_CHANCE = 1e-7
TRIM = " \t\n\r\f\v.,;:!?\"'()[]{}<>*#%&$|/\\-_+=~`^@"


@dataclass
class Model:
    """Chain weights: a logit for each feature, the bias, the transition logits, and the document fit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))


def features(word: str) -> list[str]:
    """The trimmed lower-case form and its starts; starts are marked by a final ``*``."""
    w = word.strip(TRIM).lower()
    return [w, *(w[:n] + "*" for n in STARTS if len(w) > n)] if w else []


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Byte bounds of all white-space tokens, their rows' bounds, and their distinct forms with each token's form."""
    raw, offsets = K.buffers(column)
    starts, ends, first = K.bounds(~K.SPACES[raw], offsets)
    _, index, form = np.unique(K.run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    data = raw.tobytes()
    forms = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
    return raw, starts, ends, first, form, forms


def emissions(model: Model, forms: list[str]) -> np.ndarray:
    get = model.weights.get
    return np.array([model.bias + sum(get(f, 0.0) for f in features(w)) for w in forms])


def marginals(logit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every token: forward and backward odds, one step for all rows at once.

    Rows are ordered by length, so a step touches only rows that long; the odds
    of the two states carry all a two-state chain needs, without underflow.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, size = first[:-1][order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # rows with more than t tokens
    odds = np.exp(np.clip(logit, -60, 60))
    a = np.exp(trans)
    fwd, bwd = np.empty_like(odds), np.ones_like(odds)
    r = np.ones(len(size))
    for t in range(longest):
        at = begin[: alive[t]] + t
        if t:
            p = r[: alive[t]]
            r = np.clip(odds[at] * (a[0, 1] + p * a[1, 1]) / (a[0, 0] + p * a[1, 0]), 1e-30, 1e30)
        else:
            r = odds[at]
        fwd[at] = r
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        x = np.clip(odds[at + 1] * bwd[at + 1], 1e-30, 1e30)
        bwd[at] = (a[1, 0] + x * a[1, 1]) / (a[0, 0] + x * a[0, 1])
    both = fwd * bwd
    return both / (1 + both)


def background(model: Model) -> float:
    """The marginal of a token that shows nothing, among others like it."""
    n = 9
    return float(marginals(np.full(n, model.bias), np.array([0, n]), model.trans)[n // 2])


def evidence(p: np.ndarray, first: np.ndarray, floor: float) -> np.ndarray:
    """Document features: bias, log of the expected toxic tokens, log of their density, the largest marginal.

    Marginals count from twice the background on, so that a long text does not
    gather evidence from tokens that show nothing.
    """
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(np.maximum(p - 2 * floor, 0.0))])
    mass = total[first[1:]] - total[first[:-1]]
    top = np.zeros(len(n))
    full = n > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.column_stack([np.ones(len(n)), np.log1p(8 * mass), np.log1p(1000 * mass / np.maximum(n, 1)), top])


def doc_scores(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model.doc, -30, 30)))


def pair_mass(logit: np.ndarray, first: np.ndarray, trans: np.ndarray, p: np.ndarray) -> float:
    """Expected number of neighbouring tokens that both are toxic, from the marginals and the chain."""
    n = len(p)
    if n < 2:
        return 0.0
    inner = np.ones(n, dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    # P(1 | neighbour 1) under the chain, with the right neighbour's evidence held in its own marginal odds.
    left, right = p[:-1] / (1 - p[:-1] + 1e-12), p[1:] / (1 - p[1:] + 1e-12)
    a = np.exp(trans)
    prior = (a[0, 1] + left * a[1, 1]) / (a[0, 0] + left * a[1, 0])
    e = right / prior
    both = left * a[1, 1] * e
    return float((both / (a[0, 0] + a[0, 1] * e + left * a[1, 0] + both))[inner[1:]].sum())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Newton's method for a penalised, weighted logistic fit (few columns)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
    return w


def families(form: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """First document of each family of copies: documents that share one of four minima of their 5-word shingles."""
    owner: dict[tuple[int, int], int] = {}
    keep = np.ones(len(first) - 1, dtype=bool)
    h = hashes[form]
    for i in range(len(first) - 1):
        w = h[first[i] : first[i + 1]]
        m = max(len(w) - 4, 1)
        g = np.zeros(m, dtype=np.uint64)
        for j in range(min(5, len(w))):
            g = K.mix(g + w[j : j + m])
        for salt in range(4):
            key = (salt, int(K.mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)).min()))
            keep[i] &= owner.setdefault(key, i) == i
    return keep


def lexicon(forms: list[str], form: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Features that label tokens: far more toxic documents hold them than chance would give.

    Features of too few toxic documents to pass are let go before clean ones are counted.
    """
    base = float(toxic.mean())

    def counts(label: int, among: Counter | None) -> Counter:
        seen: Counter = Counter()
        for i in np.flatnonzero(toxic == label).tolist():
            own = {f for k in np.unique(form[first[i] : first[i + 1]]).tolist() for f in features(forms[k])}
            seen.update(own if among is None else [f for f in own if f in among])
        return seen

    least = log(MAX_CHANCE) / log(base)
    hits = Counter({f: k for f, k in counts(1, None).items() if k > least})
    misses = counts(0, hits)
    found = set()
    for f, k1 in hits.items():
        n = k1 + misses[f]
        share = k1 / n
        if share > base:
            # Chernoff bound of the binomial tail.
            gap = share * log(share / base) + ((1 - share) * log((1 - share) / (1 - base)) if share < 1 else 0.0)
            if exp(-n * gap) < MAX_CHANCE:
                found.add(f)
    return found


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0, rounds: int = 40, rate: float = 0.5) -> Model:
    """Fit the chain to token labels derived from document labels, then the document score.

    ``clean_weight``: how many clean documents one of the sample stands for.
    """
    model = Model()
    toxic = np.asarray(toxic, dtype=np.int64)
    if len(set(toxic.tolist())) == 2:
        _, _, _, first, form, forms = tokens(pa.array(texts, pa.string()))
        raw, offsets = K.buffers(pa.array(forms, pa.string()))
        keep = families(form, first, K.run_hashes(raw, offsets[:-1], offsets[1:]))
        texts, toxic = [t for t, k in zip(texts, keep.tolist(), strict=True) if k], toxic[keep]
    if len(set(toxic.tolist())) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        model.doc[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    _, _, _, first, form, forms = tokens(pa.array(texts, pa.string()))
    seeds = lexicon(forms, form, first, toxic)
    hot = np.array([any(f in seeds for f in features(w)) for w in forms], dtype=bool)
    # All features of labelled forms have weights.
    vocab = {f: i for i, f in enumerate(sorted({f for k in np.flatnonzero(hot).tolist() for f in features(forms[k])}))}
    doc_of = np.repeat(np.arange(len(toxic)), np.diff(first))
    label = hot[form] & (toxic[doc_of] == 1)
    pairs = np.array([(k, vocab[f]) for k, w in enumerate(forms) for f in features(w) if f in vocab], dtype=np.int64).reshape(-1, 2)
    owner, flat = pairs[:, 0].copy(), pairs[:, 1].copy()
    uses = np.bincount(form, minlength=len(forms)).astype(float)
    got = np.bincount(form[label], minlength=len(forms)).astype(float)
    scale = np.bincount(flat, weights=uses[owner], minlength=len(vocab)) + 4.0
    inner = np.ones(len(form), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    y = label.astype(float)
    both = float((y[1:] * y[:-1] * inner[1:]).sum())
    w, bias, trans = np.zeros(len(vocab)), -6.0, np.zeros((2, 2))
    for _ in range(rounds):
        logit = (np.bincount(owner, weights=w[flat], minlength=len(forms)) + bias)[form]
        p = marginals(logit, first, trans)
        want = np.bincount(form, weights=p, minlength=len(forms))
        grad = np.bincount(flat, weights=(got - want)[owner], minlength=len(vocab)) - 0.3 * w
        w = w + rate * np.clip(8 * grad / scale, -2, 2)
        bias += 0.3 * rate * np.clip(8 * (y.sum() - p.sum()) / (y.sum() + p.sum() + 4.0), -1, 1)
        trans[1, 1] = np.clip(trans[1, 1] + rate * np.clip((both - pair_mass(logit, first, trans, p)) / (y.sum() + 4.0), -0.5, 0.5), -3, 3)
    model.weights = {f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 1e-3}
    model.bias, model.trans = float(bias), trans
    x = evidence(marginals(emissions(model, forms)[form], first, trans), first, background(model))
    model.doc = _logistic(x, toxic.astype(float), np.where(toxic == 1, 1.0, clean_weight), penalty=1.0)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fit on rows whose crc32(doc_id as text) mod 5 is not 0; at most ``max_train`` documents of either class."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    held = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    both = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for c in (1, 0)]
    ids = both[0].unionByName(both[1])  # at most 2 * max_train rows of two numbers: small enough to broadcast
    chosen = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id")
    rows = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    K.frugal()
    kept = Counter(r["toxic"] for r in rows)
    # Each class stands for its share of all training rows.
    weight = (held.get(0, 0) / max(kept[0], 1)) / max(held.get(1, 0) / max(kept[1], 1), 1e-9) if kept[1] else 1.0
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows]), clean_weight=weight)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` and ``score, n_toxic, spans`` (code point offsets ``start, end`` and the marginal ``p``) of every whole text.

    ``prefix`` is put before the three names where they clash with kept ones.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.frugal()
        m = shared.value
        floor = background(m)
        for batch in batches:
            for lo, hi in K.slices(batch.column(names[-1])):
                part = batch.slice(lo, hi - lo)
                text = part.column(names[-1])
                raw, starts, ends, first, form, forms = tokens(text)
                p = marginals(emissions(m, forms)[form], first, m.trans) if len(form) else np.zeros(0)
                x = evidence(p, first, floor)
                hot = np.flatnonzero(p > 0.5)
                # Code points before a byte: the bytes that do not continue a character.
                lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                row = np.searchsorted(first, hot, side="right") - 1
                base = lead[K.buffers(text)[1][:-1]]
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i, s, e, q in zip(row.tolist(), (lead[starts[hot]] - base[row]).tolist(), (lead[ends[hot]] - base[row]).tolist(), p[hot].tolist(), strict=True):
                    spans[i].append({"start": s, "end": e, "p": q})
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(doc_scores(m, x)), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=[*keep, *(f"{prefix}{k}" for k in ("score", "n_toxic", "spans"))])

    rows = docs.select(*keep, F.col("text").cast("string").alias(unused(docs, "text_in")))
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}, {prefix}score double, {prefix}n_toxic long, {prefix}spans array<struct<start:int,end:int,p:double>>")


ship(__name__)

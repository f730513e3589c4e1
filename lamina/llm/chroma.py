"""Chroma fingerprints of audio columns and their alignment (free style: Arrow batches, DataFrame joins).

A recording (an array of samples) is cut into overlapping frames; the spectrum
of each frame is folded into twelve pitch classes and normalised. Over the
frames-by-classes image, sums of rectangles come from an integral image; sixteen
filters compare such sums, and each comparison, quantised to two bits in Gray
code, gives two bits of a 32-bit integer per image position.

Recordings of equal fingerprints are one class, so copies are never paired with
one another. At the limit of unlike bits two recordings need not share a single
integer, so no key finds all of them: every query is compared with every class
at every offset, in blocks of bounded size. The offset with the least share of
unlike bits aligns the two and decides; of equal ones that with the longest
overlap, then the one nearest to 0. A query meets a class once, not once per
copy. The work grows with the queries times the classes, and so do the links at
a loose limit: ``links`` returns all of them between classes, and who is in each
class; ``aligned`` a row per pair; ``summary`` only counts and the best of a query.

Null and empty arrays, null samples (taken as 0), infinite or undefined samples
(as 0) and recordings shorter than one image window are handled: the last have
no fingerprint and match nothing. Repeated rows of an id are copies; recordings
without an id count as members of their class. An empty table gives an empty
result. Only the id and the sample column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import sent, ship, small_batches, written

CLASSES = 12
#: Samples of a frame, step between frames, length of the padded spectrum, samples a second.
FRAME, HOP, SPECTRUM, RATE = 16, 2, 256, 8000
#: Frames an image window spans.
WIDTH = 8
#: Limits between the four levels of a filter's response (a log ratio).
LEVELS = (-0.25, 0.0, 0.25)
GRAY = (0, 1, 3, 2)
MAX_BER = 0.25
MIN_OVERLAP = 8
#: Integers of a block of queries and of a block of classes.
QUERY_CODES, CLASS_CODES = 2048, 4096


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, from a rule: kinds in turn over growing rectangles."""
    out = []
    for i in range(16):
        height = 2 + (i * 5) % 9
        out.append((i % 6, (i * 7) % (CLASSES - height + 1), height, WIDTH - (i % 3) * 2))
    return out


def pitch_matrix(frame: int = FRAME, spectrum: int = SPECTRUM, rate: int = RATE) -> np.ndarray:
    """Share of each frequency bin in each pitch class (nearest semitone; bins below one cycle a frame are left out)."""
    freq = np.arange(1, spectrum // 2 + 1) * rate / spectrum
    pitch = np.round(12 * np.log2(freq / 440.0)).astype(int) % CLASSES
    m = np.zeros((spectrum // 2 + 1, CLASSES))
    m[np.arange(1, spectrum // 2 + 1), pitch] = freq >= rate / frame
    return m


def chroma(x: np.ndarray, frame: int = FRAME, hop: int = HOP, spectrum: int = SPECTRUM, rate: int = RATE) -> np.ndarray:
    """Normalised pitch-class energies: (recordings, frames, 12) of equally long recordings."""
    n = (x.shape[1] - frame) // hop + 1
    frames = np.lib.stride_tricks.sliding_window_view(x, frame, axis=1)[:, ::hop][:, :n] * np.hamming(frame)
    power = np.abs(np.fft.rfft(frames, spectrum, axis=2)) ** 2
    c = power @ pitch_matrix(frame, spectrum, rate)
    norm = np.linalg.norm(c, axis=2, keepdims=True)
    return np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), 0.0)


def fingerprint(image: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Packed integers (recordings, positions) of images (recordings, frames, 12)."""
    r, n, _ = image.shape
    if n < width:
        return np.zeros((r, 0), np.int64)
    total = np.zeros((r, n + 1, CLASSES + 1))
    total[:, 1:, 1:] = image.cumsum(axis=1).cumsum(axis=2)
    t = np.arange(n - width + 1)

    def area(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        return total[:, t + b, hi] - total[:, t + a, hi] - total[:, t + b, lo] + total[:, t + a, lo]

    out = np.zeros((r, len(t)), np.int64)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:
            part = whole / 2 - (whole - area(0, w, 0, CLASSES) / CLASSES * h) / 2
        elif kind == 1:
            part = area(0, w, y, y + h // 2)
        elif kind == 2:
            part = area(0, w // 2, y, y + h)
        elif kind == 3:
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 4:
            part = area(0, w, y + h // 3, y + h - h // 3)
        else:
            part = area(w // 4, w - w // 4, y, y + h)
        value = np.log((np.maximum(part, 0.0) + 1e-3) / (np.maximum(whole - part, 0.0) + 1e-3))
        level = np.searchsorted(LEVELS, value, side="right")
        out = (out << 2) | np.asarray(GRAY)[level]
    return out


def _prints(id_name: str, sample_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(sample_name).cast(pa.list_(pa.float64()))
            samples = [np.nan_to_num(np.array([0.0 if v is None else v for v in x.as_py() or []] if x.is_valid else [], dtype=float), posinf=0.0, neginf=0.0) for x in column]
            found: list[list[int]] = [[] for _ in samples]
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(samples):
                by_size.setdefault(len(x), []).append(i)
            for size, rows in by_size.items():
                if size >= FRAME + HOP * (WIDTH - 1):
                    step = max(1, 4_000_000 // (size * SPECTRUM // HOP + 1))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        for i, p in zip(part, fingerprint(chroma(np.stack([samples[k] for k in part]))).tolist(), strict=True):
                            found[i] = p
            yield pa.RecordBatch.from_arrays([batch.column(id_name).cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["rec_id", "print"])

    return run


def fingerprints(recordings: DataFrame, id_name: str, sample_name: str) -> DataFrame:
    """``rec_id, print``: one packed integer per image position."""
    small_batches(recordings.sparkSession)
    return recordings.select(id_name, sample_name).mapInArrow(_prints(id_name, sample_name), "rec_id long, print array<long>")


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of 32-bit integers as rows of 64-bit words, the last filled up with zeros."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray(codes).view(np.uint64)


def compare(q: np.ndarray, c: np.ndarray, max_ber: float, min_overlap: int) -> tuple[np.ndarray, ...]:
    """Best alignments of the rows of ``q`` with the rows of ``c`` (uint32): row in q, row in c, offset, votes, overlap, unlike bits."""
    offsets = []
    for o in range(min_overlap - q.shape[1], c.shape[1] - min_overlap + 1):
        lo = max(0, -o)
        n = min(q.shape[1], c.shape[1] - o) - lo
        if n >= max(min_overlap, 1):
            offsets.append((-n, abs(o), o, lo))
    best = np.full(len(q) * len(c), np.inf)
    at, overlap, errors = (np.zeros(len(best), np.int64) for _ in range(3))
    for minus, _, o, lo in sorted(offsets):
        n = -minus
        x, y = _words(q[:, lo : lo + n]), _words(c[:, lo + o : lo + o + n])
        unlike = np.bitwise_count(x.T[:, :, None] ^ y.T[:, None, :]).sum(axis=0, dtype=np.int32).ravel()
        ber = unlike / (32 * n)
        new = np.flatnonzero((ber <= max_ber) & (ber < best))
        best[new], at[new], overlap[new], errors[new] = ber[new], o, n, unlike[new]
    found = np.flatnonzero(best < np.inf)
    i, j = found // len(c), found % len(c)
    votes = np.zeros(len(found), np.int64)
    for o in np.unique(at[found]).tolist():
        here = np.flatnonzero(at[found] == o)
        lo, n = max(0, -o), int(overlap[found[here[0]]])
        for part in range(0, len(here), 10_000):
            k = here[part : part + 10_000]
            votes[k] = (q[i[k], lo : lo + n] == c[j[k], lo + o : lo + o + n]).sum(axis=1)
    return i, j, at[found], votes, overlap[found], errors[found]


PAIR = "query_key long, class_key long, at_offset int, votes long, overlap int, bit_errors long, ber double"
#: Per query class and block: aligned classes, their recordings, the best alignment.
SUMMARY = "query_key long, n_classes long, n_recordings long, " + PAIR.removeprefix("query_key long, ")


def _summed(q_keys: np.ndarray, i: np.ndarray, key: np.ndarray, size: np.ndarray, overlap: np.ndarray, ber: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of ``i`` with counts and sizes, and where their best alignment stands."""
    order = np.lexsort((key, -overlap, ber, i))
    own, first = np.unique(i[order], return_index=True)
    total = np.add.reduceat(size[order], first) if len(first) else np.zeros(0, np.int64)
    return q_keys[own], np.diff(np.append(first, len(order))), total, order[first]


def _compared(max_ber: float, min_overlap: int, summed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q_keys, q_codes, keys, sizes, codes = (batch.column(name)[k].values.to_numpy() for name in ("q_keys", "q_codes", "keys", "sizes", "codes"))
                q, c = (v.view(np.uint32).reshape(len(r), -1) for v, r in ((q_codes, q_keys), (codes, keys)))
                i, j, at, votes, overlap, errors = compare(q, c, max_ber, min_overlap)
                # A recording is no alignment of its own; the other members of its class are.
                sized = sizes[j] - (q_keys[i] == keys[j])
                real = sized > 0
                i, j, at, votes, overlap, errors, sized = (v[real] for v in (i, j, at, votes, overlap, errors, sized))
                ber = errors / (32 * overlap)
                columns = [q_keys[i]]
                if summed:
                    own, n, total, best = _summed(q_keys, i, keys[j], sized, overlap, ber)
                    columns = [own, n, total]
                    j, at, votes, overlap, errors, ber = (v[best] for v in (j, at, votes, overlap, errors, ber))
                columns += [keys[j], at.astype(np.int32), votes, overlap.astype(np.int32), errors, ber]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=[x.split()[0] for x in (SUMMARY if summed else PAIR).split(", ")])

    return run


def _blocks(classes: DataFrame, codes: int) -> DataFrame:
    """``keys, sizes, codes``: classes of equally long fingerprints, about ``codes`` integers a row, in signed 32 bits (the top bit is turned)."""
    sized = classes.withColumn("n", F.size("print"))
    many = sized.groupBy("n").agg(F.ceil(F.count("*") * F.col("n") / codes).cast("long").alias("blocks"))
    placed = sized.join(many, "n").withColumn("block", F.pmod(F.xxhash64("class_key"), F.col("blocks")))
    signed = F.transform("print", lambda x: (x - 2**31).cast("int"))
    held = placed.groupBy("n", "block").agg(F.collect_list(F.struct("class_key", "class_size", signed.alias("codes"))).alias("b"))
    return held.select(F.col("b.class_key").alias("keys"), F.col("b.class_size").alias("sizes"), F.flatten("b.codes").alias("codes"))


class Search:
    """Every query against every class at every offset; ``classes`` and ``members`` (queries and their classes) are written tables."""

    def __init__(self, prints: DataFrame, queries: DataFrame, max_ber: float = MAX_BER, min_overlap: int = MIN_OVERLAP) -> None:
        self.max_ber, self.min_overlap = max_ber, min_overlap
        classes = prints.where(F.size("print") > 0).groupBy("print").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_size"))
        self.classes = written(classes.withColumn("class_key", F.monotonically_increasing_id()))
        # Queries are classes too: alignments are found per class and given to its queries at the end.
        known = self.classes.select("print", F.col("class_key").alias("query_key"))
        self.members = written(queries.join(known, "print", "left").select(F.col("rec_id").alias("query_id"), "query_key").distinct())

    def judged(self, summed: bool) -> DataFrame:
        asked = self.classes.join(self.members.select(F.col("query_key").alias("class_key")).distinct(), "class_key", "left_semi")
        q = written(_blocks(asked, QUERY_CODES).select(F.col("keys").alias("q_keys"), F.col("codes").alias("q_codes")))
        # A fixed number of parts: the rows are few, the work on each is not.
        c = _blocks(self.classes, CLASS_CODES).repartition(4 * q.sparkSession.sparkContext.defaultParallelism)
        return c.crossJoin(q).mapInArrow(_compared(self.max_ber, self.min_overlap, summed), SUMMARY if summed else PAIR)

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``class_id`` and ``class_size`` of their ``class_key``."""
        return rows.join(self.classes.select("class_key", "class_id", "class_size"), "class_key", "left")


def aligned(prints: DataFrame, queries: DataFrame, max_ber: float = MAX_BER, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Classes that queries align with: ``query_id, class_id, class_size, at_offset, votes, overlap, bit_errors, ber``.

    ``class_id`` is the least id of the recordings with that fingerprint;
    ``votes`` counts the equal integers along the overlap (the offset histogram
    at that offset); a query's own class is not listed unless it has further
    members. There are as many rows as pairs.
    """
    s = Search(prints, queries, max_ber, min_overlap)
    out = s.named(s.members.join(s.judged(False), "query_key"))
    return out.select("query_id", "class_id", "class_size", "at_offset", "votes", "overlap", "bit_errors", "ber")


def links(prints: DataFrame, queries: DataFrame, max_ber: float = MAX_BER, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """The whole search: ``kind, rec_id, is_query, class_id, class_size, linked_id, linked_size, at_offset, votes, overlap, bit_errors, ber``.

    A row of kind ``member`` for each row of ``prints``, with its class (null
    without a fingerprint), and one of kind ``link`` for each class that the class
    of a query aligns with, with the alignment. A class goes by the least id in it,
    and links with itself where it has further members: copies are read off the
    members and are not paired with one another. Queries are told by their ids.
    """
    s = Search(prints, queries, max_ber, min_overlap)
    asked = sent(written(s.members.select("query_id", F.lit(True).alias("asked")).distinct()))
    held = prints.join(s.classes, "print", "left").join(asked, F.col("rec_id").eqNullSafe(F.col("query_id")), "left")
    member = held.select(F.lit("member").alias("kind"), "rec_id", F.coalesce("asked", F.lit(False)).alias("is_query"), "class_id", "class_size")
    names = sent(s.classes.select("class_key", "class_id", "class_size"))
    own = names.select(F.col("class_key").alias("query_key"), "class_id", "class_size")
    other = names.select("class_key", F.col("class_id").alias("linked_id"), F.col("class_size").alias("linked_size"))
    found = s.judged(False).join(own, "query_key").join(other, "class_key")
    fields = [x.split()[0] for x in PAIR.split(", ")[2:]]
    return member.unionByName(found.select(F.lit("link").alias("kind"), "class_id", "class_size", "linked_id", "linked_size", *fields), allowMissingColumns=True)


def summary(prints: DataFrame, queries: DataFrame, max_ber: float = MAX_BER, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """One row per query: its class, how much it aligns with, and its best alignment.

    ``query_id, query_class, n_classes, n_recordings`` (aligned classes, and the
    recordings in them beside the query itself), ``class_id, class_size,
    at_offset, votes, overlap, bit_errors, ber`` of the alignment with the least
    share of unlike bits, then the longest overlap, then the first class. The
    same links as ``aligned`` gives, summed where they are found. A query without a
    fingerprint has no link.
    """
    s = Search(prints, queries, max_ber, min_overlap)
    fields = [x.split()[0] for x in PAIR.split(", ")[2:]]
    best = F.min(F.struct("ber", (-F.col("overlap")).alias("short"), "class_key", *[f for f in fields if f != "ber"])).alias("b")
    per = s.judged(True).groupBy("query_key").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_recordings").alias("n_recordings"), best)
    per = s.named(per.select("query_key", "n_classes", "n_recordings", F.col("b.class_key").alias("class_key"), *[F.col(f"b.{f}").alias(f) for f in fields]))
    own = s.classes.select(F.col("class_key").alias("query_key"), F.col("class_id").alias("query_class"))
    out = s.members.join(own, "query_key", "left").join(per, "query_key", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select("query_id", "query_class", zero("n_classes"), zero("n_recordings"), "class_id", "class_size", *fields)


ship(__name__)

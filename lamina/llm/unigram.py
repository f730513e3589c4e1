"""SentencePiece unigram encoding and decoding (free style: Arrow batches).

The pieces of a public ``.model`` file (its path is a parameter) and their
scores form a double-array trie over bytes. The best segmentation maximises the
sum of scores (Viterbi; among equals the one whose last piece is longest, as the
first found stays). Characters that no piece covers become byte pieces. A space
is the white-space marker, and one marker is put before the text; decoding
turns markers into spaces, joins bytes, and drops that first space.

No piece crosses from a non-marker to a marker, nor joins a byte that stands in
no longer piece, so a text is cut there and each distinct segment of a batch is
segmented once, all segments at a time. Whole texts are encoded, whatever their
length; a very long segment takes a plain loop with the same recurrence.

Null and empty texts have no token. Repeated rows are encoded each. An empty
table gives an empty result. Other columns are kept by ``encode_frame``'s caller,
who selects what it needs; ``ids`` is the only name that is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import ship, small_batches

MARKER = "▁"
#: Fixed values of the model file's format: piece types, and the penalty of a character without a piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Segments up to this number of bytes go through the vectorised recurrence.
LONG = 256
#: Cells (segments times bytes) of one call of that recurrence.
CELLS = 1 << 19
#: Mandelbrot's shift of ranks.
RANK_SHIFT = 2.7


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file, in the order of ids."""
    with open(path, "rb") as f:
        data = f.read()
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            held = dict(_fields(value))
            score = float(np.frombuffer(held[2], dtype="<f4")[0]) if 2 in held else 0.0
            pieces.append((held.get(1, b"").decode(), score, held.get(3, NORMAL)))
    return pieces


def log_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The pieces with log probabilities as scores.

    Files of merges hold ranks (0, -1, -2, ...; pieces at -1e9 are out of use).
    A rank r becomes the Zipf-Mandelbrot log probability -log(r + shift) - log Z:
    nothing is trained. Other files hold log probabilities already.
    """
    ranks = [s for _, s, kind in pieces if kind == NORMAL and s > -1e8]
    if len(ranks) < 2 or any(s > 0 or s != int(s) for s in ranks) or len(set(ranks)) < len(ranks):
        return pieces
    z = float(np.log(np.sum(1 / (RANK_SHIFT - np.array(ranks)))))
    return [(p, -float(np.log(RANK_SHIFT - s)) - z if kind == NORMAL and s > -1e8 else s, kind) for p, s, kind in pieces]


@dataclass
class Unigram:
    """A double-array trie (``base``, ``check``), the piece that ends at each node, scores and bytes of pieces."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    unknown_score: float
    byte_ids: np.ndarray
    unknown_id: int
    text_at: np.ndarray
    text: np.ndarray
    alone: np.ndarray
    depth: int


def _double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First-fit placement of a trie's nodes, level by level; a child's slot is its parent's base plus its byte plus one."""
    trie: list[dict[int, int]] = [{}]
    value = [-1]
    for word, i in words:
        node = 0
        for b in word:
            nxt = trie[node].get(b)
            if nxt is None:
                nxt = len(trie)
                trie[node][b] = nxt
                trie.append({})
                value.append(-1)
            node = nxt
        value[node] = i
    size = len(trie) * 4 + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    after = list(range(size + 1))  # after[x]: the least free slot from x on, once followed to its end

    def free(x: int) -> int:
        seen = x
        while after[x] != x:
            x = after[x]
        while after[seen] != x:
            after[seen], seen = x, after[seen]
        return x

    after[0] = 1
    low, todo = 1, [(0, 0)]
    while todo:
        node, slot = todo.pop()
        piece[slot] = value[node]
        keys = sorted(trie[node])
        if not keys:
            continue
        first = free(max(low if len(keys) > 1 else 1, keys[0] + 1))
        tries = 0
        while any(after[first - keys[0] + k] != first - keys[0] + k for k in keys[1:]):
            first = free(first + 1)
            tries += 1
        if tries > 100:  # the region before is crowded
            low = first
        at = first - keys[0] - 1
        base[slot] = at
        for k in keys:
            after[at + k + 1] = at + k + 2
            check[at + k + 1] = slot
            todo.append((trie[node][k], at + k + 1))
    pad = np.zeros(260, np.int32)
    return np.concatenate([base, pad]), np.concatenate([check, pad - 1]), np.concatenate([piece, pad - 1])


def build(pieces: list[tuple[str, float, int]]) -> Unigram:
    surface = [p.replace(MARKER, " ").encode() for p, _, _ in pieces]
    entries = [(s, i) for i, (s, (_, _, kind)) in enumerate(zip(surface, pieces, strict=True)) if kind in (NORMAL, USER_DEFINED) and s]
    base, check, piece = _double_array(entries)
    score = np.array([s for _, s, _ in pieces], dtype=np.float64)
    normal = [s for _, s, kind in pieces if kind == NORMAL and s > -1e8]
    byte_ids = np.full(256, -1, np.int32)
    shown = list(surface)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(p[1:-1], 16)] = i
            shown[i] = bytes([int(p[1:-1], 16)])
        elif kind in (CONTROL, UNKNOWN):
            shown[i] = b""
    unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
    inside = np.zeros(256, dtype=bool)
    for s, _ in entries:
        if len(s) > 1:
            inside[list(s)] = True
    alone = ~inside
    alone[0x80:] = False
    crossing = any(b" " in s.lstrip(b" ") for s, _ in entries)
    if crossing:  # pieces over several words: only whole texts can be segmented
        raise ValueError("pieces that hold a marker behind other characters are not supported")
    return Unigram(base, check, piece, score, (min(normal) if normal else 0.0) - UNKNOWN_PENALTY, byte_ids, unknown, np.concatenate([[0], np.cumsum([len(s) for s in shown])]), np.frombuffer(b"".join(shown), dtype=np.uint8), alone, max(len(s) for s, _ in entries))


def _char_length(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _plain(m: Unigram, s: bytes) -> list[int]:
    """The recurrence over one segment, in plain Python."""
    n = len(s)
    best, prev, ids = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, piece, score = m.base, m.check, m.piece, m.score
    for p in range(n):
        if best[p] == -np.inf or s[p] & 0xC0 == 0x80:
            continue
        width = int(_char_length(np.uint8(s[p])))
        node, single = 0, False
        for q in range(p, min(n, p + m.depth)):
            nxt = int(base[node]) + s[q] + 1
            if check[nxt] != node:
                break
            node = nxt
            i = int(piece[node])
            if i >= 0:
                single |= q + 1 - p == width
                value = best[p] + score[i]
                if value > best[q + 1]:
                    best[q + 1], prev[q + 1], ids[q + 1] = value, p, i
        if not single and best[p] + m.unknown_score > best[min(p + width, n)]:
            q = min(p + width, n)
            best[q], prev[q], ids[q] = best[p] + m.unknown_score, p, -1
    out: list[int] = []
    q = n
    while q > 0:
        p = prev[q]
        out.extend([ids[q]] if ids[q] >= 0 else _bytes(m, s[p:q])[::-1])
        q = p
    return out[::-1]


def _bytes(m: Unigram, s: bytes) -> list[int]:
    got = [int(m.byte_ids[b]) for b in s]
    return got if min(got) >= 0 else [m.unknown_id]


def segment(m: Unigram, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments (flat) and the segments' bounds."""
    out: list[list[int] | np.ndarray | None] = [None] * len(segments)
    size = np.array([len(s) for s in segments], dtype=np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = _plain(m, segments[i])
    lo = 0
    for hi in (8, 16, 32, 64, LONG):
        own = np.flatnonzero((size > lo) & (size <= hi))
        lo = hi
        step = CELLS // hi
        for at in range(0, len(own), step):
            part = own[at : at + step]
            for i, ids in zip(part.tolist(), _batch(m, [segments[i] for i in part.tolist()], size[part], hi), strict=True):
                out[i] = ids
    lengths = np.array([0 if x is None else len(x) for x in out], dtype=np.int64)
    flat = [x for x in out if x is not None and len(x)]
    return (np.concatenate([np.asarray(x, np.int32) for x in flat]) if flat else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(lengths)])


def _batch(m: Unigram, segments: list[bytes], size: np.ndarray, width: int) -> list[list[int]]:
    """The same recurrence for many short segments at once."""
    n = len(segments)
    text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), dtype=np.uint8).reshape(n, width)
    best = np.full((n, width + 5), -np.inf)
    best[:, 0] = 0.0
    prev, ids = np.zeros((n, width + 5), np.int16), np.full((n, width + 5), -1, np.int32)
    for p in range(int(size.max())):
        row = np.flatnonzero((size > p) & (best[:, p] > -np.inf) & ((text[:, p] & 0xC0) != 0x80))
        if not len(row):
            continue
        chars = _char_length(text[row, p])
        single = np.zeros(n, dtype=bool)
        start = best[:, p].copy()
        live, node = row, np.zeros(len(row), np.int64)
        for d in range(m.depth):
            inside = size[live] > p + d
            live, node = live[inside], node[inside]
            if not len(live):
                break
            nxt = m.base[node].astype(np.int64) + text[live, p + d] + 1
            ok = m.check[nxt] == node
            live, node = live[ok], nxt[ok]
            got = m.piece[node]
            has = got >= 0
            hit, got = live[has], got[has]
            value = start[hit] + m.score[got]
            better = value > best[hit, p + d + 1]
            hit, got, value = hit[better], got[better], value[better]
            best[hit, p + d + 1], prev[hit, p + d + 1], ids[hit, p + d + 1] = value, p, got
            single[live[has]] |= _char_length(text[live[has], p]) == d + 1
        lone = ~single[row]
        row, end = row[lone], np.minimum(p + chars[lone], size[row[lone]])
        value = start[row] + m.unknown_score
        better = value > best[row, end]
        row, end, value = row[better], end[better], value[better]
        best[row, end], prev[row, end], ids[row, end] = value, p, -1
    # Back through all segments at once; the ids come last first.
    pos, live = size.copy(), np.arange(n)
    found: list[list[int]] = [[] for _ in range(n)]
    while len(live):
        end = pos[live]
        begin, got = prev[live, end].astype(np.int64), ids[live, end]
        for i, a, b, k in zip(live.tolist(), begin.tolist(), end.tolist(), got.tolist(), strict=True):
            if k >= 0:
                found[i].append(k)
            else:
                found[i].extend(_bytes(m, segments[i][a:b])[::-1])
        pos[live] = begin
        live = live[begin > 0]
    return [x[::-1] for x in found]


def encode(m: Unigram, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows (flat) and the rows' bounds."""
    import pyarrow.compute as pc

    column = column.cast(pa.large_string()).fill_null("")
    column = pc.replace_substring(column, MARKER, " ")
    column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
    raw, offsets = K.buffers(column)
    n = len(raw)
    space, alone = raw == 32, m.alone[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n:
        cut[1:n] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[n] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    _, index, form = np.unique(K.run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    data = raw.tobytes()
    flat, bound = segment(m, [data[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
    lengths = np.diff(bound)[form]
    ends_at = np.cumsum(lengths)
    total = int(ends_at[-1]) if len(ends_at) else 0
    pick = np.arange(total) - np.repeat(ends_at - lengths, lengths) + np.repeat(bound[:-1][form], lengths)
    first = np.searchsorted(starts, offsets)
    return flat[pick], np.concatenate([[0], ends_at])[first]


def decode(m: Unigram, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of rows of ids; bytes that are no UTF-8 are replaced."""
    sizes = np.diff(m.text_at)[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    pick = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(m.text_at[:-1][ids], sizes)
    raw = m.text[pick].tobytes()
    bounds = np.concatenate([[0], ends])[at]
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.array([t.removeprefix(" ") for t in texts], pa.string())


def encode_frame(docs: DataFrame, model_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of int), ``n_bytes`` (byte pieces) and ``round_trip`` (decoding gives the text) of every whole text."""
    small_batches(docs.sparkSession)
    model = build(log_scores(read_pieces(model_path or default_model())))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    docs = docs.select(*keep, F.col("text").cast("string").alias("text_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        K.frugal()
        m = shared.value
        is_byte = np.zeros(len(m.score), dtype=np.int64)
        is_byte[m.byte_ids[m.byte_ids >= 0]] = 1
        for batch in batches:
            for lo, hi in K.slices(batch.column("text_in")):
                part = batch.slice(lo, hi - lo)
                ids, at = encode(m, part.column("text_in"))
                seen = np.concatenate([[0], np.cumsum(is_byte[ids])])
                same = pc.equal(decode(m, ids, at), part.column("text_in").cast(pa.string()).fill_null(""))
                lists = pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists, pa.array(seen[at[1:]] - seen[at[:-1]]), same], names=[*keep, "ids", "n_bytes", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.mapInArrow(run, f"{kinds}, ids array<int>, n_bytes long, round_trip boolean")


ship(__name__)

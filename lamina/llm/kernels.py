"""Vectorised text kernels on Arrow string buffers: word bounds and 64-bit hashes without a Python loop per word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from lamina.llm.common import ship

U64 = np.uint64
#: Bytes that are hashed at once.
PIECE = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def frugal() -> None:
    """In a worker: give freed memory of large arrays back at once, as workers outlive their tasks."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # blocks from this size on are mapped, whatever was freed before
    except (OSError, AttributeError):  # another C library
        return
    pa.set_memory_pool(pa.system_memory_pool())


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 1 << 21):
    """Row ranges of at most ``limit`` bytes each (a longer single row stands alone)."""
    sizes = np.diff(buffers(column)[1])
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes that cross no row bound, and runs before each row."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    last = inside & (~after | edge[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    up = np.full(n, BASE, dtype=U64)
    down = np.full(n, BASE_INVERSE, dtype=U64)
    up[:1] = down[:1] = U64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(raw: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of coded bytes."""
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_CODES[raw] * up[: len(raw)], out=sums[1:])
    return sums


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte run (in order, without overlap): prefix sums of coded bytes, shifted to a common origin, then mixed.

    Works on pieces of ``PIECE`` bytes, so its memory does not grow with the text.
    """
    n = len(starts)
    total = np.zeros(n, dtype=U64)
    up, down = powers(min(len(raw), PIECE) + 1)
    i = 0
    while i < n:
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        if int(ends[j - 1]) - at <= PIECE:
            sums = _sums(raw[at : int(ends[j - 1])], up)
            s, e = starts[i:j] - at, ends[i:j] - at
            total[i:j] = (sums[e] - sums[s]) * down[s]
        else:  # one run that is longer than a piece
            whole = 0
            for k in range(at, int(ends[i]), PIECE):
                own = int(_sums(raw[k : min(k + PIECE, int(ends[i]))], up)[-1])
                whole += own * pow(int(BASE), k - at, 2**64)
            total[i] = U64(whole % 2**64)
        i = j
    return mix(total + (ends - starts).astype(U64))


ship(__name__)

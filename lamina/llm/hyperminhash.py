"""Near-duplicate documents by HyperMinHash sketches (free style: Arrow batches and DataFrame joins).

A document is the set of its distinct word shingles. Each shingle hash falls
into one of ``REGISTERS`` buckets; a bucket stores, for its least hash, the
number of leading zeros and the mantissa bits behind the leading one. Bands of
compressed registers propose documents of alike content, the share of equal
registers (corrected for chance collisions) estimates the Jaccard similarity,
and what stays is confirmed on the full sets.

No group is ever expanded into all its pairs. Documents with equal sets are one
class from the start. Every class is first compared with the likeliest of the
least members of its buckets only; confirmed links give components, and buckets
whose members are all in one component are done. In the others, sketches are
compared in blocks of bounded size, across components only; a block pair emits
no more than a spanning forest of what may be linked. Its trees are the groups
whose full sets are compared, again in blocks and across components only, and a
confirmed link merges two components at once.

Nulls and texts without words have an empty set: they are linked with nothing.
Every row gets a row: one of a repeated id is judged by its own text, and rows
that are repeated as a whole share their result. A row without an id links like
others; it names no component, goes where one with an id is in its component, and
stays otherwise. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lamina.llm import kernels as K
from lamina.llm.common import ROW, components, row_key, sent, ship, small_batches, without, written

WORDS = 5
#: Hundredths of Jaccard similarity from which two documents are near copies.
NEAR = 80
REGISTERS = 256
MANTISSA = 10
#: Share of the pairs at the threshold that may share no band.
MISSED = 5e-6
#: Standard errors below the threshold at which an estimate still is verified.
SLACK = 5.0
#: Rows and shingles of a block in the comparison of a group's members.
BLOCK = 1000
BLOCK_SHINGLES = 2_000_000
U64 = np.uint64


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, with the bounds of each row's set, and the rows' numbers of words."""
    raw, offsets = K.buffers(column)
    raw = K.LOWER[raw]
    starts, ends, first = K.bounds(~K.SPACES[raw], offsets)
    h = K.run_hashes(raw, starts, ends)
    n = len(h)
    per_row = np.diff(first)
    m = max(n - words + 1, 0)
    grams = np.zeros(m, dtype=U64)
    factor = U64(1)
    for j in range(words):
        factor = U64((int(factor) * 0xD6E8FEB86659FD93) % 2**64)
        grams += h[j : j + m] * factor
    grams = K.mix(grams)
    sets, sizes = [], np.zeros(len(per_row), dtype=np.int64)
    for i, (a, k) in enumerate(zip(first.tolist(), per_row.tolist(), strict=False)):
        if k >= words:
            one = np.unique(grams[a : a + k - words + 1])
        elif k:
            whole = U64(k)
            for x in h[a : a + k].tolist():
                whole = U64((int(whole) * 0xBF58476D1CE4E5B9 + x) % 2**64)
            one = K.mix(np.array([whole], dtype=U64))
        else:
            continue
        sets.append(one)
        sizes[i] = len(one)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]), per_row


def registers(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows' registers: zeros of the least hash of a bucket, then mantissa; 0 marks an empty bucket."""
    rows = len(at) - 1
    out = np.zeros((rows, REGISTERS), dtype=np.uint16)
    row = np.repeat(np.arange(rows), np.diff(at))
    bucket = (flat % U64(REGISTERS)).astype(np.int64)
    value = K.mix(flat ^ U64(0xA5A5A5A5A5A5A5A5))
    order = np.argsort(value, kind="stable")[::-1]  # the least value of a bucket is written last
    least = np.zeros(rows * REGISTERS, dtype=U64)
    slot = (row * REGISTERS + bucket)[order]
    least[slot] = value[order]
    slots = np.unique(slot)
    v = least[slots]
    bits = np.zeros(len(v), dtype=np.int64)  # position of the leading one
    rest = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> U64(step)
        big = high > 0
        bits += step * big
        rest = np.where(big, high, rest)
    zeros = np.minimum(63 - bits, 62)
    shift = np.maximum(bits - MANTISSA, 0).astype(U64)
    mantissa = ((v >> shift) & U64((1 << MANTISSA) - 1)).astype(np.int64)
    out.reshape(-1)[slots] = ((zeros + 1) * (1 << MANTISSA) + mantissa).astype(np.uint16)
    return out


def band_rows(hundredths: int) -> int:
    """The most registers a band may have for no more than ``MISSED`` of the pairs at the threshold to be lost."""
    fits = [k for k in range(1, REGISTERS + 1) if (1 - (hundredths / 100) ** k) ** (REGISTERS // k) <= MISSED]
    return max(fits, default=1)


def band_keys(regs: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, band and 64-bit key of each band of ``height`` registers that holds a non-empty one."""
    bands = REGISTERS // height
    r = regs[:, : bands * height].reshape(len(regs), bands, height)
    key = np.broadcast_to(np.arange(bands, dtype=U64) + U64(1), r.shape[:2]).copy()
    for j in range(height):
        key = K.mix(key * U64(0x9E3779B97F4A7C15) + r[:, :, j].astype(U64))
    row, band = np.nonzero(r.any(axis=2))
    return row, band, key[row, band]


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance collisions, and the registers they rest on."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    chance = 2.0 ** -(MANTISSA + 1)  # two unlike minima agree in zeros and mantissa about so often
    t = same / np.maximum(used, 1)
    return np.clip((t - chance) / (1 - chance), 0, 1), used


def passes(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    j, used = estimate(a, b)
    return j >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    K.frugal()
    for batch in batches:
        for a, b in K.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            flat, at, _ = shingle_sets(part.column("text"))
            regs = registers(flat, at)
            sizes = np.diff(at)
            # The set's identity: two independent sums over its elements, and its size.
            sums = []
            for salt in (0x51ED270B, 0x2545F491):
                total = np.concatenate([[U64(0)], np.cumsum(K.mix(flat ^ U64(salt)), dtype=U64)])
                sums.append(_signed(total[at[1:]] - total[at[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in ("doc_id", *ROW)), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", *ROW, "n_shingles", "set_a", "set_b", "regs"],
            )


def _bands(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            row, band, key = band_keys(regs, height)
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(band.astype(np.int32)), pa.array(_signed(key))], names=["rep", "band", "key"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    K.frugal()
    for batch in batches:
        for a, b in K.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            flat, at, _ = shingle_sets(part.column("text"))
            sets = pa.LargeListArray.from_arrays(pa.array(at), pa.array(_signed(flat)))
            yield pa.RecordBatch.from_arrays([part.column("rep"), sets.cast(pa.list_(pa.int64()))], names=["rep", "set"])


@F.pandas_udf(DoubleType())
def _margin(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    """The estimate, negative where it lies too far below the threshold."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b))
    j, _ = estimate(x, y)
    return pd.Series(np.where(passes(x, y, float(threshold.iloc[0])), j, -1.0))


def _common(hundredths: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("set_x", "set_y"):
                column = batch.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy()))
            keep = np.zeros(batch.num_rows, dtype=bool)
            (ox, vx), (oy, vy) = sides
            for i in range(batch.num_rows):
                keep[i] = linked(vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]], hundredths)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return verify


def linked(x: np.ndarray, y: np.ndarray, hundredths: int) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < hundredths * large:
        return False
    inter = small + large - len(np.union1d(x, y))
    return 100 * inter >= hundredths * (len(x) + len(y) - inter)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds; rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(rows.num_rows, dtype=bool)
        change[0] = True
        for k in range(keys):
            v = rows.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if len(starts) > 1:  # the last group may go on in the next batch
            yield rows.slice(0, starts[-1]), starts
        held = rows.slice(starts[-1]).to_batches()
    if held and sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def _regs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _pairs_within(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs inside groups with the given bounds."""
    size = np.diff(starts)
    left, right = [], []
    for m in np.unique(size).tolist():
        if m > 1:
            i, j = np.triu_indices(m, 1)
            at = starts[:-1][size == m][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


#: Groups up to this size are compared all at once, pair by pair; the number of pairs is linear in the rows.
SMALL = 12


def _alike_size(a: np.ndarray, b: np.ndarray, hundredths: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= hundredths * np.maximum(a, b)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    own = bool((side == 0).any())
    left = np.flatnonzero(side != 2)
    return left, (left if own else np.flatnonzero(side == 2)), own


def _forest(hundredths: int):
    """Spanning forest of the pairs of each block pair that may be linked and are in several components."""
    threshold = hundredths / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups_of(batches, 4):
            if starts[-1] != rows.num_rows:
                starts = np.append(starts, rows.num_rows)
            regs = _regs(rows)
            reps, side, comp, size = (rows.column(k).to_numpy() for k in ("rep", "side", "comp", "n_shingles"))
            tree = np.arange(len(reps))
            edges: list[tuple[int, int]] = []

            def root(i: int, tree: np.ndarray = tree) -> int:
                while tree[i] != i:
                    tree[i] = tree[tree[i]]
                    i = tree[i]
                return int(i)

            def join(i: int, o: int, tree: np.ndarray = tree, edges: list = edges, reps: np.ndarray = reps, root=root) -> None:
                x, y = root(i), root(o)
                if x != y:
                    edges.append((reps[i], reps[o]))
                    tree[y] = x

            width = np.diff(starts)
            small = (width <= SMALL) & (width > 1)
            for at in range(0, len(width), 20_000):
                own = np.flatnonzero(small[at : at + 20_000]) + at
                # Bounds of the small groups, put side by side.
                index = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in own.tolist()]) if len(own) else np.zeros(0, np.int64)
                x, y = _pairs_within(np.concatenate([[0], np.cumsum(width[own])]))
                x, y = index[x], index[y]
                fits = (comp[x] != comp[y]) & _alike_size(size[x], size[y], hundredths)
                x, y = x[fits], y[fits]
                for part in range(0, len(x), 50_000):
                    i, o = x[part : part + 50_000], y[part : part + 50_000]
                    good = passes(regs[i], regs[o], threshold)
                    for p, q in zip(i[good].tolist(), o[good].tolist(), strict=True):
                        join(p, q)
            for g in np.flatnonzero(width > SMALL).tolist():
                base = int(starts[g])
                left, right, alone = _sides(side[base : starts[g + 1]])
                label = np.arange(starts[g + 1] - base)  # trees of this group
                for at, i in enumerate(left.tolist()):
                    others = right[at + 1 :] if alone else right
                    others = others[label[others] != label[i]]
                    others = others[(comp[base + others] != comp[base + i]) & _alike_size(size[base + others], size[base + i], hundredths)]
                    if len(others):
                        for o in others[passes(regs[base + i][None, :], regs[base + others], threshold)].tolist():
                            if label[o] != label[i]:
                                edges.append((reps[base + i], reps[base + o]))
                                label[label == label[o]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _merges(hundredths: int):
    """Links between components of each block pair; rows of side 1 against rows of side 2, or a block (side 0) against itself."""
    threshold = hundredths / 100

    def compare(regs: np.ndarray, reps: np.ndarray, side: np.ndarray, comp: np.ndarray, size: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        comp = comp.copy()
        left, right, own = _sides(side)
        links = []
        for at, i in enumerate(left.tolist()):
            others = right[at + 1 :] if own else right
            others = others[(comp[others] != comp[i]) & _alike_size(size[others], size[i], hundredths)]
            if not len(others):
                continue
            j, _ = estimate(regs[i][None, :], regs[others])
            good = passes(regs[i][None, :], regs[others], threshold)
            for o in others[good][np.argsort(-j[good], kind="stable")].tolist():
                if comp[o] != comp[i] and linked(sets[i], sets[o], hundredths):
                    links.append((min(reps[i], reps[o]), max(reps[i], reps[o])))
                    comp[comp == comp[o]] = comp[i]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups_of(batches, 3):
            if starts[-1] != rows.num_rows:
                starts = np.append(starts, rows.num_rows)
            regs = _regs(rows)
            reps, side, comp, size = (rows.column(k).to_numpy() for k in ("rep", "side", "comp", "n_shingles"))
            column = rows.column("set").combine_chunks()
            flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            sets = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            links: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                links += compare(regs[a:b], reps[a:b], side[a:b], comp[a:b], size[a:b], sets[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups as runs of rows, so that many small ones share a task's call."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _facing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows dealt into ``blocks`` blocks by ``rep``: a block meets itself (side 0) and each other block once (the lower is side 1, the higher side 2)."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q"), F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side")),
    )
    return rows.select(*columns, F.explode(meets).alias("m")).select(*columns, "m.*")


def near_duplicates(docs: DataFrame, hundredths: int = NEAR) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``hundredths``/100 or more over their shingle sets.

    Returns ``doc_id, row_a, row_b`` (the row's key), ``n_shingles, component_id,
    kept``, one row per row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    threshold = hundredths / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("*", *row_key(docs))
    schema = "doc_id long, row_a long, row_b long, n_shingles long, set_a long, set_b long, regs binary"
    sketches = written(docs.mapInArrow(_sketch, schema))

    # Equal sets are one class; its text is that of the row with the least key.
    filled = sketches.where("n_shingles > 0")
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.any_value("regs").alias("regs"), F.min("doc_id").alias("least"), F.min(F.struct(*ROW)).alias("row"))
    reps = written(classes.select("*", "row.*").drop("row").withColumn("rep", F.monotonically_increasing_id()))
    rows = reps.select("rep", "regs").mapInArrow(_bands(band_rows(hundredths)), "rep long, band int, key long")
    # Buckets of two or more, each with its least member.
    buckets = rows.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.count("*").alias("members")).where("members > 1")
    member = written(rows.join(buckets, ["band", "key"]).select("band", "key", "rep", "lead"))

    light = reps.select("rep", "regs", "n_shingles")
    # The likeliest leader of each class.
    pairs = member.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    x, y = (light.select(F.col("rep").alias(k), F.col("regs").alias(f"regs_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
    sized = pairs.join(x, "a").join(y, "b").where(100 * F.least("n_a", "n_b") >= hundredths * F.greatest("n_a", "n_b"))
    judged = sized.select("a", "b", _margin("regs_a", "regs_b", F.lit(threshold)).alias("j")).where("j >= 0")
    proposed = judged.groupBy("b").agg(F.max_by("a", F.struct("j", (-F.col("a")).alias("a"))).alias("a")).select("a", "b")
    wanted = reps.select("rep", *ROW).join(member.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select(*ROW, "text").join(sent(written(wanted)), ROW).groupBy(*ROW, "rep").agg(F.any_value("text").alias("text"))
    sets = written(texts.select("rep", "text").mapInArrow(_sets, "rep long, set array<long>"))
    x, y = (sets.select(F.col("rep").alias(k), F.col("set").alias(f"set_{n}")) for k, n in (("a", "x"), ("b", "y")))
    links = written(proposed.join(x, "a").join(y, "b").select("a", "b", "set_x", "set_y").mapInArrow(_common(hundredths), "a long, b long"))
    comp = written(components(links))

    # Buckets whose members still are in several components; groups of them that share no bucket.
    named = comp.select(F.col("id").alias("rep"), "comp")
    placed = member.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    many = mixed.select("band", "key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    facing = _facing(placed.join(many, ["band", "key"]).join(light, "rep"), ["band", "key", "rep", "comp", "regs", "n_shingles"])
    facing = facing.select("band", "key", "p", "q", "rep", "comp", "regs", "n_shingles", "side")
    trees = written(_sorted_by(facing, "band", "key", "p", "q").mapInArrow(_forest(hundredths), "a long, b long"))
    groups = written(components(trees))
    inside = groups.select(F.col("id").alias("rep"), F.col("comp").alias("grp")).join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(light, "rep")
    weights = inside.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    full = _facing(inside.join(weights, "grp").join(sets, "rep"), ["grp", "rep", "comp", "regs", "n_shingles", "set"])
    full = full.select("grp", "p", "q", "rep", "comp", "regs", "n_shingles", "set", "side")
    merges = _sorted_by(full, "grp", "p", "q").mapInArrow(_merges(hundredths), "a long, b long")
    comp = written(components(links.unionByName(merges)).select(F.col("id").alias("rep"), "comp"))

    # A component is named by its least id.
    ids = reps.select("rep", "set_a", "set_b", F.col("n_shingles").alias("n"), "least")
    label = written(comp.join(ids.select("rep", "least"), "rep").groupBy("comp").agg(F.min("least").alias("label")))
    named = written(ids.join(comp, "rep", "left").join(label, "comp", "left").select("set_a", "set_b", "n", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("label")).alias("component"), F.lit(True).alias("linked")))
    out = sketches.select("doc_id", *ROW, "n_shingles", "set_a", "set_b")
    joined = out.join(named, [out.set_a == named.set_a, out.set_b == named.set_b, F.col("n_shingles") == F.col("n")], "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", *ROW, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, hundredths: int = NEAR) -> DataFrame:
    """``docs`` with one document of each component (rows that are repeated as a whole stand or fall together)."""
    return without(docs, near_duplicates(docs, hundredths).where("not kept"))


def oracle(hundredths: int = 85, words: int = WORDS) -> str:
    """The query's rows in DuckDB SQL: all pairs that share a shingle, and all that is reachable along links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {split} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= {hundredths} * (nx.n + ny.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b.y, r.root FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) b ON b.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""


ship(__name__)

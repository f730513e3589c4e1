"""Vector and structure search: metrics, exact top-k, several queries, layer filters, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import name_hash32
from lamina.functions.text import in_layer, path_shingles

#: Defaults of a search.
K, ALPHA, BETA = 10, 0.7, 0.3
#: Queries that are sent to every task at once.
MAX_QUERIES = 10_000
#: The order of the one-hot layer bits, and where the other parts of the 256 bits start.
LAYER_BITS = ("terminology", "prose", "organization", "relation", "decision", "source", "plan", "artifact", "revision", "llm", "index")
NAMESPACE_AT, PATH_AT, ELEMENT_AT, OUT_AT, IN_AT = 11, 43, 171, 187, 219
WIDTHS = {NAMESPACE_AT: 32, PATH_AT: 128, ELEMENT_AT: 16, OUT_AT: 32, IN_AT: 32}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is below 1e-12."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


def tanimoto(a: Column, b: Column) -> Column:
    """Common bits over all bits of two arrays of longs; 1 where both are empty."""
    total = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    both, either = total(lambda x, y: x.bitwiseAND(y)), total(lambda x, y: x.bitwiseOR(y))
    return F.when(either == 0, 1.0).otherwise(both / either)


def bits(positions: Column) -> Column:
    """Four longs with the given bits (0 to 255) set."""
    word = lambda k: F.aggregate(F.filter(positions, lambda p: F.floor(p / 64) == k), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
    return F.array(*[word(k) for k in range(4)])


def fingerprint(layer: Column, namespace: Column, path: Column, element: Column, outgoing: Column, incoming: Column) -> Column:
    """The 256 structural bits of a node: layer, namespace, path shingles, element, relation types out and in."""
    bucket = lambda name, at: (F.lit(at) + F.pmod(name_hash32(name), F.lit(WIDTHS[at]))).cast("int")
    one_hot = F.array_position(F.array(*[F.lit(x) for x in LAYER_BITS]), layer).cast("int") - 1
    each = lambda names, at: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: bucket(n, at))
    return bits(F.concat(F.when(one_hot >= 0, F.array(one_hot)).otherwise(F.array().cast("array<int>")), F.array(bucket(namespace, NAMESPACE_AT)), each(path_shingles(path), PATH_AT), F.array(bucket(element, ELEMENT_AT)), each(outgoing, OUT_AT), each(incoming, IN_AT)))


def score(cos: Column, tan: Column | None, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Reported score: the structural part counts only where a layer was asked for."""
    return alpha * cos + (beta * tan if tan is not None else F.lit(0.0))


def distance(cos: Column, tan: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return alpha * (1 - cos) + beta * (1 - tan)


def top_k(index: DataFrame, queries: DataFrame, k: int = K, alpha: float = ALPHA, beta: float = BETA, layered: bool = False) -> DataFrame:
    """Exact search: ``query_id, id, cos, tan, score, rank`` of the k best per query.

    Queries ``(query_id, q_embedding, q_bits)`` are few (more than ``MAX_QUERIES``
    are refused: ask in parts) and meet every row of the index ``(id, embedding,
    bits)``; per task only the k best of each query survive to the shuffle.
    """
    scored = _scored(index, queries)
    scored = scored.withColumn("score", F.round(score(F.col("cos"), F.col("tan") if layered else None, alpha, beta), 8))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, cos, tan`` of every query and row."""
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: ask in parts")
    pairs = index.crossJoin(F.broadcast(queries))
    tan = tanimoto(F.col("bits"), F.col("q_bits"))
    return pairs.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q_embedding")), 6).alias("cos"), F.round(tan, 6).alias("tan"))


def nearest(index: DataFrame, queries: DataFrame, k: int = K, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """``query_id, id, dist, rank`` by the index's metric, exactly."""
    measured = _scored(index, queries).withColumn("dist", F.round(distance(F.col("cos"), F.col("tan"), alpha, beta), 8))
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return measured.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_search(index: DataFrame, queries: DataFrame, layer: str | None = None, allowed: DataFrame | None = None, k: int = K) -> DataFrame:
    """``top_k`` within a layer (short or long name; the structural part counts then) and among ``allowed(id)``, both applied before ranking."""
    if layer is not None:
        index = index.where(in_layer(F.col("layer"), layer))
    if allowed is not None:
        index = index.join(allowed.select("id").distinct(), "id", "left_semi")
    return top_k(index, queries, k, layered=layer is not None)


def best_of(hits: DataFrame, k: int = K) -> DataFrame:
    """Union of several queries' hits: the best score per id, score falling, id rising, the first k."""
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hashed_embedding(text: Column, dims: int = 384) -> Column:
    """Counts of hashed words, scaled to length one: a deterministic stand-in where no model is at hand."""
    slots = F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"), F.lit(dims)).cast("int"))
    # Sorted, equal slots stand together: each is counted from where it starts to where the next one does.
    ordered = lambda x: F.array_sort(x)
    counted = F.transform(F.array(ordered(slots)), lambda s: F.transform(F.array(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (F.size(s) > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))), lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), F.transform(at, lambda i, k: (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("double"))))[0])[0]
    dense = F.transform(F.array(F.when(F.size(slots) > 0, counted).otherwise(F.create_map().cast("map<int,double>"))), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))[0]
    return F.transform(F.array(dense), lambda c: F.transform(F.array(F.sqrt(dot(c, c))), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))[0][0]

"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts become word arrays. A k-gram of ``K_WORDS`` words is hashed at every word,
and of every ``WINDOW - K_WORDS + 1`` successive hashes the least is kept, the
first one on ties. Two texts that share ``WINDOW`` successive words share all the
hashes of such a window, so they keep a common fingerprint: the join of training
and test fingerprints misses no span of ``WINDOW`` words or more. Each common
fingerprint gives a diagonal (document position less item position); along it
the words themselves are compared, and runs of ``WINDOW`` equal words or more
are hits. Items of fewer words than a window are one window; a k-gram of their
whole length, looked up at every document word, finds them.

Null and wordless texts have no words and no hit; wordless items have no window.
Every row gets a row, whatever its id: texts are told apart by a 128-bit digest
and equal ones are matched once. Repeated item ids with different texts are
joined as separate windows but one item; items without an id have no name to be
reported by and are left out. Empty tables give empty results or no
hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import BROADCAST_ROWS, ROW, bound, row_key, sent, without, written

WINDOW = 13
K_WORDS = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters that separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Names of a text's key.
TEXT = ["text_a", "text_b"]


def words(text: Column) -> Column:
    """Lower-cased words; no word is empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def gram(w: Column, i: Column, k: int) -> Column:
    """Hash of the k words from index i (0-based)."""
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def packed(w: Column, i: Column, k: int) -> Column:
    """One long that orders by the k-gram's hash, then its position; the hash has 37 bits, the position 26."""
    return F.shiftrightunsigned(gram(w, i, k), 27).bitwiseAND(F.lit(2**37 - 1)) * F.lit(2**26) + i


def every_gram(w: Column, k: int) -> Column:
    """Packed hashes of all k-grams."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: packed(w, i, k))


def sliding_min(g: Column, n: int) -> Column:
    """The least of every ``n`` successive values: minima of 2, 4, 8, ... are combined."""

    def step(c: Column, shift: int) -> Column:
        # The shifted array is shorter; least() passes over the nulls that fill it up.
        return bound(c, lambda x: F.zip_with(x, F.slice(x, shift + 1, F.size(x)), lambda a, b: F.least(a, b)))

    def over(x: Column) -> Column:
        cur, span = x, 1
        while 2 * span <= n:
            cur, span = step(cur, span), 2 * span
        if span < n:
            cur = step(cur, n - span)
        return F.slice(cur, F.lit(1), F.size(x) - n + 1)

    return bound(g, over)


def fingerprints(w: Column, k: int = K_WORDS, window: int = WINDOW) -> Column:
    """Packed winnowed k-grams of a word array: the least hash of each window, the first on ties.

    Null where the array is shorter than a window.
    """
    return F.array_distinct(sliding_min(F.when(F.size(w) >= window, every_gram(w, k)), window - k + 1))


def unpacked(v: Column) -> list[Column]:
    return [F.shiftrightunsigned(v, 26).alias("h"), v.bitwiseAND(F.lit(2**26 - 1)).cast("int").alias("at")]


def _words(column: str = "text") -> Column:
    return words(F.col(column).cast("string")).alias("w")


def matched_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K_WORDS) -> DataFrame:
    """Maximal spans that texts share with items: ``text_a, text_b`` (the text's key), ``item_id, first, last`` (0-based words of the text).

    A span is a run of at least ``window`` equal words, or a whole shorter item.
    """
    return Matches(docs, items, window, k).spans


class Matches:
    """Fingerprints, diagonals and spans of one run; ``rows`` has every row's id, keys and number of words."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K_WORDS) -> None:
        keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        keyed = keyed.select("*", *row_key(keyed), *[x.alias(n) for x, n in zip(row_key(keyed, "text"), TEXT, strict=True)])
        it = written(items.select(F.col("item_id").cast("string").alias("item_id"), _words()).where("item_id is not null").where(F.size("w") > 0).distinct().withColumn("item", F.xxhash64("item_id", "w")))
        test = it.select("item", F.explode(fingerprints(F.col("w"), k, window)).alias("v"))
        short = it.where(F.size("w") < window)
        lengths = sorted(r[0] for r in short.select(F.size("w").alias("n")).distinct().collect())  # at most window - 1 numbers
        for n in lengths:
            test = test.unionByName(short.where(F.size("w") == n).select("item", packed(F.col("w"), F.lit(0), n).alias("v")))
        test = written(test.select("item", *unpacked(F.col("v"))))

        none = F.array().cast("array<bigint>")
        shapes = lambda w: [fingerprints(w, k, window), *(F.when(F.size(w) >= n, every_gram(w, n)) for n in lengths)]
        # The only pass over all texts.
        wide = keyed.select("doc_id", *ROW, *TEXT, _words())
        prints = written(wide.select("doc_id", *ROW, *TEXT, F.size("w").cast("long").alias("n_words"), F.concat(*[F.coalesce(s, none) for s in shapes(F.col("w"))]).alias("prints")))
        self.rows = prints.drop("prints")
        train = prints.select(*TEXT, F.explode("prints").alias("v")).select(*TEXT, *unpacked(F.col("v")))
        side = test.select("h", "item", F.col("at").alias("item_at"))
        if test.count() <= BROADCAST_ROWS:
            side = F.broadcast(side)
        diagonals = written(train.join(side, "h").select(*TEXT, "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
        # Of equal texts one row's is read again.
        chosen = self.rows.join(diagonals.select(*TEXT).distinct(), TEXT, "left_semi").groupBy(*TEXT).agg(F.min(F.struct(*ROW)).alias("row")).select(*TEXT, "row.*")
        texts = keyed.select(*ROW, "text").join(sent(written(chosen)), ROW).groupBy(*ROW, *TEXT).agg(F.any_value("text").alias("text"))
        self.spans = _extended(diagonals, texts.select(*TEXT, _words()), it, window)


def _extended(diagonals: DataFrame, texts: DataFrame, it: DataFrame, window: int) -> DataFrame:
    """Runs of equal words along the diagonals that are long enough."""
    both = diagonals.join(texts, TEXT).join(it.select("item", "item_id", F.col("w").alias("iw")), "item")
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(F.size("iw"), F.size("w") - F.col("shift")) - 1
    need = F.least(F.lit(window), F.size("iw"))
    # One pass along the diagonal: the run so far, and the spans that are long enough.
    step = lambda acc, i: F.when(
        F.get(F.col("iw"), i) == F.get(F.col("w"), i + F.col("shift")),
        F.struct((acc["run"] + 1).alias("run"), acc["spans"].alias("spans")),
    ).otherwise(F.struct(F.lit(0).alias("run"), close(acc, i).alias("spans")))
    close = lambda acc, i: F.when(
        acc["run"] >= need,
        F.concat(acc["spans"], F.array(F.struct((i - acc["run"] + F.col("shift")).alias("first"), (i - 1 + F.col("shift")).alias("last")))),
    ).otherwise(acc["spans"])
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    spans = F.aggregate(F.sequence(lo, hi), start, step, lambda acc: close(acc, hi + 1))
    long_enough = both.where(hi - lo + 1 >= need)
    return long_enough.select(*TEXT, "item_id", F.explode(spans).alias("s")).select(*TEXT, "item_id", "s.first", "s.last").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 5) -> DataFrame:
    """Per row: ``doc_id, row_a, row_b`` (the row's key), ``n_words, n_hit, n_items, items_sha256, contaminated``.

    Contaminated: a hit, and hit words of ``percent``/100 of all words or more.
    """
    found = Matches(docs, items)
    spans = written(found.spans)
    # Spans of one text are merged in order; the number of its spans is bounded by its length.
    ordered = spans.groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    covered = F.aggregate(
        "s",
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["last"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["end"] + 1, x["first"]) + 1)).alias("n")),
        lambda acc: acc["n"],
    )
    hits = ordered.select(*TEXT, covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    out = found.rows.join(written(hits), TEXT, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        *ROW,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def cleaned(docs: DataFrame, items: DataFrame, percent: int = 5) -> DataFrame:
    """``docs`` without the contaminated rows."""
    return without(docs, decontaminate(docs, items, percent).where("contaminated"))


def oracle(window: int = WINDOW) -> str:
    """The query's rows in DuckDB SQL: every window of every item looked up at every document word."""
    split = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATORS}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {split} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM it)),
dw AS (SELECT rid, n, j, array_to_string(w[j : j + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM it) WHERE len(w) >= n)),
m AS (SELECT rid, j, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + n)) AS p FROM m) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)"""

"""Secret scan: fixed patterns and sliding-window Shannon entropy (DataFrame functions only).

Base spans come from three fixed patterns, leftmost and non-overlapping per
kind. Candidate strings (runs of at least ``WINDOW`` characters that secrets are
made of, with a letter and a digit) are scanned by a window of ``WINDOW``
characters. Its character counts are kept in an array; moving it by one changes
two of them, and the sum of ``c log2 c`` by their terms, which gives the entropy. From the first to the last window that
reaches the limit of the candidate's character class is a span of kind
``entropy``, unless the allow-list matches the candidate or a base span holds it.

Null and empty texts have no span; a null id stays null. Repeated rows are
scanned each. Texts are scanned whole, in time linear in their length; offsets count code points, the end is exclusive. An empty table
gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bound

# The base patterns, in the order of their kinds, and the classes of candidates.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN = 12
WINDOW = 20
#: Characters of a long candidate that are scanned at once.
PIECE = 4096
#: Matches whose positions are summed at once.
BLOCK = 256
#: Counts of five bits (a window's are at most ``WINDOW``) that a long holds.
PER_WORD = 12
#: Entropy limits in bits, for windows of 20: hexadecimal, letters and digits, all candidate characters.
LIMITS = {"^[0-9a-fA-F]+$": 3.0, "^[0-9A-Za-z]+$": 3.8, "": 3.9}
#: Candidates that are no secrets: UUIDs, dates and times, alphabets, placeholders, paths of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9-]*$",
    r"(?i)(0123456789|abcdefghij|example|placeholder|changeme|xxxxxx)",
    r"^/?([A-Za-z_-]+/)+[A-Za-z0-9_-]*$",
)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """(gap, match) structs: each match of the pattern and the characters before it, in one linear pass."""
    full = rf"(?s)(.*?)({pattern}|\z)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(full), 1).alias("gap"), F.regexp_extract_all(text, F.lit(full), 2).alias("match"))


def located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that ``keep`` accepts; positions are sums of the lengths before.

    Sums are made over blocks of ``BLOCK`` matches first, then inside each, so
    that no array of all spans is copied once per match.
    """
    width = lambda m: F.length(m["gap"]) + F.length(m["match"])

    def inside(block: Column, first: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(m["gap"])
            end = start + F.length(m["match"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["match"].alias("match"))
            return F.struct(end.alias("at"), F.when(keep(m["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
        return F.aggregate(block, F.struct(first.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    def over(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))

        def placed(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, m: acc + width(m)))
            firsts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
            return F.flatten(F.zip_with(parts, F.slice(firsts, F.lit(1), F.size(parts)), inside))

        return bound(blocks, placed)

    return bound(matches(text, pattern), over)


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def windows(s: Column, limit: Column) -> Column:
    """(first, last) of the window ends (1-based) whose entropy reaches the limit; 0 where none does.

    The accumulator holds the window's count of each distinct character of
    ``s``, five bits each and ``PER_WORD`` to a long, and the sum of ``c log2 c``;
    a step changes the counts of the character that leaves and of the one that
    enters, and the sum by their terms.
    """
    terms = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    f = lambda c: F.get(terms, c)
    count = lambda counts, x: F.call_function("shiftrightunsigned", F.get(counts, x["word"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        """Counts, sum and position after one character; out is 0 while the window fills up."""
        old, new = x["out"], x["in"]
        out_now = count(acc["counts"], old)
        in_now = count(acc["counts"], new) - (new["at"] == old["at"]).cast("int")
        total = acc["total"] + F.when(old["at"] > 0, f(out_now - 1) - f(out_now)).otherwise(0.0) + f(in_now + 1) - f(in_now)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == new["word"], new["unit"]).otherwise(0) - F.when((k == old["word"]) & (old["at"] > 0), old["unit"]).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("total"), (acc["i"] + 1).alias("i"))

    def mark(acc: Column, x: Column) -> Column:
        def marked(n: Column) -> Column:
            # Rounded, as the sum's last bits depend on the order of additions.
            hit = (n["i"] >= WINDOW) & (F.round(F.log2(F.lit(float(WINDOW))) - n["total"] / WINDOW, 6) >= limit)
            return F.struct(
                n["counts"].alias("counts"),
                n["total"].alias("total"),
                n["i"].alias("i"),
                F.when(hit & (acc["first"] == 0), n["i"]).otherwise(acc["first"]).alias("first"),
                F.when(hit, n["i"]).otherwise(acc["last"]).alias("last"),
            )

        return bound(step(acc, x), marked)

    def scanned(chars: Column) -> Column:
        def over(alphabet: Column) -> Column:
            at = F.transform(F.concat(F.array_repeat(F.lit(""), WINDOW), chars), lambda c: F.array_position(alphabet, c).cast("int"))
            place = lambda k: F.struct(k.alias("at"), F.floor((k - 1) / PER_WORD).cast("int").alias("word"), (F.pmod(k - 1, F.lit(PER_WORD)) * 5).alias("shift"))
            placed = F.transform(F.transform(at, place), lambda x: F.struct(x["at"], x["word"], x["shift"], F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"]).alias("unit")))
            words = F.array_repeat(F.lit(0).cast("long"), F.floor((F.size(alphabet) - 1) / PER_WORD).cast("int") + 1)
            start = F.struct(words.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"))
            moves = bound(placed, lambda p: F.zip_with(F.slice(p, F.lit(WINDOW + 1), F.size(chars)), F.slice(p, F.lit(1), F.size(chars)), lambda x, y: F.struct(x.alias("in"), y.alias("out"))))
            return F.aggregate(moves, start, mark, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

        return bound(F.array_distinct(chars), over)

    # A long candidate is cut into pieces that overlap by a window less one character, so its arrays stay short.
    stride = PIECE - WINDOW + 1
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(s) - WINDOW) / stride).cast("int")))
    found = F.transform(pieces, lambda k: F.struct((k * stride).alias("at"), bound(F.split(F.substring(s, k * stride + 1, F.lit(PIECE)), ""), scanned).alias("w")))
    hits = F.filter(found, lambda x: x["w"]["last"] > 0)
    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))

    def ends(h: Column) -> Column:
        return F.when(F.size(h) == 0, none).otherwise(F.struct((h[0]["at"] + h[0]["w"]["first"]).alias("first"), (F.get(h, F.size(h) - 1)["at"] + F.get(h, F.size(h) - 1)["w"]["last"]).alias("last")))

    return bound(hits, ends)


def entropy_spans(candidates: Column) -> Column:
    """Spans inside located candidates."""

    def limit(s: Column) -> Column:
        return reduce(lambda rest, kv: F.when(s.rlike(kv[0]), kv[1]).otherwise(rest), reversed([kv for kv in LIMITS.items() if kv[0]]), F.lit(LIMITS[""]))

    def one(c: Column) -> Column:
        w = bound(limit(c["match"]), lambda least: windows(c["match"], least))
        return F.struct(c["start"].alias("start"), w.alias("w"))

    hits = F.filter(F.transform(candidates, one), lambda x: x["w"]["last"] > 0)
    return F.transform(hits, lambda x: F.struct((x["start"] + x["w"]["first"] - WINDOW).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (x["start"] + x["w"]["last"]).alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base`` and ``extra`` (arrays of start, kind number, end; ordered) of every whole text."""
    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    text = F.col("t")
    named = reduce(lambda a, b: a | b, [F.col("low").contains(k) for k in KEYWORDS])
    value = lambda m: F.length(F.regexp_extract(m, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1))
    allowed = lambda m: reduce(lambda a, b: a | b, [m.rlike(p) for p in ALLOWED])
    found = t.select(
        "doc_id",
        F.when(named, located(text, ASSIGN, 0, lambda m: value(m) >= MIN_ASSIGN)).otherwise(none).alias("assign"),
        F.when(text.contains("AKIA"), located(text, ACCESS, 1, lambda m: m != "")).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), located(text, HEX, 2, lambda m: m != "")).otherwise(none).alias("hex"),
        F.when(text.rlike(CANDIDATE), located(text, CANDIDATE, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~allowed(m))).otherwise(none).alias("candidates"),
    )
    base = F.array_sort(F.concat(*[plain(F.col(k)) for k in KINDS[:3]]))
    spans = found.select("doc_id", base.alias("base"), F.when(F.size("candidates") > 0, entropy_spans(F.col("candidates"))).otherwise(F.array().cast(SPAN)).alias("extra"))
    held = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    return spans.withColumn("extra", F.filter("extra", lambda x: ~held(x)))


def report(docs: DataFrame) -> DataFrame:
    spans = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"),
    )


_SQL_KIND = """
    SELECT rid, {kind} AS kind, m, s + length(g) - length(g) - length(m) AS start, s AS "end"
    FROM (SELECT rid, g, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS s
          FROM (SELECT rid, unnest(gs) AS g, unnest(ms) AS m, generate_subscripts(gs, 1) AS i
                FROM (SELECT rid, regexp_extract_all(t, '(?s)(.*?)({pattern}|\\z)', 1) AS gs,
                             regexp_extract_all(t, '(?s)(.*?)({pattern}|\\z)', 2) AS ms FROM docs)))
    WHERE {keep}"""


def oracle() -> str:
    """The same scan in DuckDB SQL; window entropies come straight from each window's characters."""
    quote = lambda p: p.replace("'", "''")
    kinds = [
        (0, ASSIGN, r"""length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= """ + str(MIN_ASSIGN)),
        (1, ACCESS, "m <> ''"),
        (2, HEX, "m <> ''"),
        (3, CANDIDATE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT (" + " OR ".join(f"regexp_matches(m, '{quote(p)}')" for p in ALLOWED) + ")"),
    ]
    found = "\n    UNION ALL".join(_SQL_KIND.format(kind=k, pattern=quote(p), keep=keep) for k, p, keep in kinds)
    cases = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {v}" for p, v in LIMITS.items() if p)
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
windows AS (
    SELECT rid, start, m, i, CASE {cases} ELSE {LIMITS['']} END AS least,
           round(list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy'), 6) AS h
    FROM (SELECT rid, start, m, unnest(range(1, length(m) - {WINDOW} + 2)) AS i FROM found WHERE kind = 3)),
extra AS (
    SELECT rid, 3 AS kind, start + min(i) - 1 AS start, start + max(i) + {WINDOW} - 1 AS "end"
    FROM windows WHERE h >= least GROUP BY rid, start, m),
base AS (SELECT rid, kind, start, "end" FROM found WHERE kind < 3),
spans AS (
    SELECT * FROM base UNION ALL
    SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.start <= x.start AND b."end" >= x."end")),
named AS (SELECT rid, kind, start, [{names}][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS s FROM spans),
per AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           count(*) FILTER (kind = 3) AS n_entropy, string_agg(s, ',' ORDER BY start, kind) AS spans,
           string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base
    FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM docs LEFT JOIN per USING (rid)"""

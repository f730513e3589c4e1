"""Quotation linking: conversations without quotes, in reply order (DataFrame functions only).

Lines that start with ``>`` marks are quotes; the number of marks is the level,
an ``On ... wrote:`` line before a quote introduces it. Successive lines of one
level are a passage. Passages are normalised (case, white space and punctuation
do not count) and hashed, and so are each message's own text, its paragraphs and
its sentences. A quoted passage is joined to the messages that hold it, first as
a whole, else by its longest sentence, as a quote may be cut out of paragraphs.
It links to the latest holder before the quoting message in its own
conversation, else to the first one of the least other conversation. Passages
of few letters are no evidence across conversations and link within one only.

A message's parent is the message that its least deep linked passage comes from,
or else the last one of the turn before it in its conversation. A link to a
later conversation is reported but gives no parent, so parents always come first
and the messages form trees; a conversation that quotes an earlier one joins its
thread, and messages without a parent are roots. Position, depth and root follow
from ranking the tour around each tree (a message is entered, then its replies
in order, then left) by pointer doubling: as many rounds as the logarithm of the
longest thread, each over what has not reached its end. Position is the place in
that pre-order: a message, then each reply with all that follows from it.

Null texts have no passage. Every row stays: rows of one conversation and turn
are ordered by role and digest of the text, and the last is the one that a next
turn replies to. Rows without conv_id or turn are linked with nothing, roots of
their own. An empty table gives an empty result. Only the four columns are read.

No conversation, passage or thread meets in one task: order is made by ranges,
what comes before a row in another range is carried over from a table of one row
per range, and joins on hot keys are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import bound, meet, written

# The lines that introduce a quote, the marks of a quoted line, the ends of sentences.
INTRO = r"^(On .{0,200}|.{0,80}) (wrote|writes|said):\s*$"
MARKS = r"^((?:\s{0,3}>\s?)*)"
SENTENCE = r"[.!?]+(?:\s+|$)"
#: Passages with fewer letters and digits than this are too common to be evidence in other conversations.
MIN_CHARS = 12


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def levels(text: Column) -> Column:
    """(level, body) of every line; the marks and one space behind each are taken off."""
    marks = lambda s: F.regexp_extract(s, MARKS, 1)
    return F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"),
        lambda s: F.struct((F.length(marks(s)) - F.length(F.replace(marks(s), F.lit(">"), F.lit("")))).alias("level"), F.substring(s, F.length(marks(s)) + 1, F.length(s)).alias("body")),
    )


def passages(lines: Column) -> Column:
    """Runs of lines of one level, cut at blank lines: (level, text) structs in order."""
    empty = F.array().cast("array<struct<level:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        blank = F.trim(x["body"]) == ""
        same = (x["level"] == acc["level"]) & (acc["text"] != "") & ~blank
        closed = F.when(acc["text"] != "", F.concat(acc["done"], F.array(F.struct(acc["level"].alias("level"), acc["text"].alias("text"))))).otherwise(acc["done"])
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed).alias("done"),
            x["level"].alias("level"),
            F.when(blank, F.lit("")).when(same, F.concat(acc["text"], F.lit("\n"), x["body"])).otherwise(x["body"]).alias("text"),
        )

    start = F.struct(empty.alias("done"), F.lit(0).alias("level"), F.lit("").alias("text"))
    return F.aggregate(lines, start, step, lambda acc: F.when(acc["text"] != "", F.concat(acc["done"], F.array(F.struct(acc["level"].alias("level"), acc["text"].alias("text"))))).otherwise(acc["done"]))


def own_text(lines: Column) -> Column:
    """The message without quoted lines and without lines that introduce a quote."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(INTRO) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    joined = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n\s*\n\s*\n", "\n\n"), r"^\s+|\s+$", "")


def longest(text: Column) -> Column:
    """The longest normalised sentence, the first of equals; null where the text is one sentence."""
    best = lambda all_: F.aggregate(all_, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return bound(sentences(text), lambda x: F.when(F.size(x) > 1, best(x)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), normalised), lambda x: x != "")


def messages(conversations: DataFrame) -> DataFrame:
    """``seq`` (orders all rows by conversation, turn, role and digest), ``conv_id, turn, role, own`` text, passages ``parts``; written."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "digest"]
    placed = rows.withColumn("digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = placed.withColumn("seq", F.monotonically_increasing_id()).withColumn("lines", levels(F.col("text")))
    return written(lined.select("seq", "conv_id", "turn", "role", own_text(F.col("lines")).alias("own"), passages(F.col("lines")).alias("parts")))


def preceding(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before``: the last non-null ``value`` of the rows that come before in ``order`` (total, over all rows).

    Rows are dealt out by ranges; what a range begins with comes from a table of
    the ranges' last values.
    """
    dealt = rows.withColumn("value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    ends = placed.where("value is not null").groupBy("part").agg(F.max_by("value", "at").alias("end"))
    parts = written(placed.select("part").distinct().join(ends, "part", "left"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = parts.select("part", F.last("end", ignorenulls=True).over(earlier).alias("carry"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("inner", F.last("value", ignorenulls=True).over(inside)).join(F.broadcast(carried), "part")
    return out.select(*rows.columns, F.coalesce("inner", "carry").alias("before"))


def links(m: DataFrame) -> DataFrame:
    """Linked quoted passages: ``seq, number`` (of the passage), ``level, to_seq, to_conv, to_turn, outer``."""
    named = m.where("conv_id is not null and turn is not null")
    quoted = named.select("seq", "conv_id", "turn", F.posexplode("parts").alias("number", "p")).where("p.level > 0")
    quoted = quoted.select("seq", "conv_id", "turn", "number", F.col("p.level").alias("level"), F.array(normalised(F.col("p.text")), longest(F.col("p.text"))).alias("keys"))
    quoted = quoted.select("seq", "conv_id", "turn", "number", "level", F.posexplode("keys").alias("rank", "key")).where(F.length("key") > 0)
    telling = F.length("key") >= MIN_CHARS
    quoted = written(quoted.where((F.col("rank") == 0) | telling).select("seq", "conv_id", "turn", "number", "level", "rank", F.md5("key").alias("h"), telling.alias("telling")))
    asked = written(quoted.groupBy("h").agg(F.count("*").alias("n")))
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"])
    units = F.array_distinct(F.concat(F.transform(F.concat(F.array(F.col("own")), own), normalised), F.flatten(F.transform(own, sentences))))
    held = named.select("seq", "conv_id", "turn", F.explode(F.transform(F.filter(units, lambda u: u != ""), lambda u: F.md5(u))).alias("h"))
    held = written(meet(held, asked, ["h"], "n", "left_semi").select("seq", "conv_id", "turn", "h"))

    # In the quoting conversation: the latest holder of an earlier turn, found in one order of holders and quotes.
    none = F.lit(None).cast("long")
    events = held.select("h", "conv_id", "turn", F.lit(1).alias("kind"), "seq", none.alias("number"), none.alias("level"), none.alias("rank"), F.lit(False).alias("telling"))
    events = events.unionByName(quoted.select("h", "conv_id", "turn", F.lit(0).alias("kind"), "seq", F.col("number").cast("long"), F.col("level").cast("long"), F.col("rank").cast("long"), "telling"))
    found = preceding(events, ["h", "conv_id", "turn", "kind", "seq", "number", "rank"], F.when(F.col("kind") == 1, F.struct("h", "conv_id", "seq", "turn"))).where("kind = 0")
    near = (F.col("before.h") == F.col("h")) & (F.col("before.conv_id") == F.col("conv_id"))
    found = written(found.withColumn("hit", F.when(near, F.struct(F.col("before.seq").alias("to_seq"), F.col("conv_id").alias("to_conv"), F.col("before.turn").alias("to_turn")))).drop("before", "kind"))
    inner = found.where("hit is not null").select("seq", "number", "level", "rank", "hit.*", F.lit(False).alias("outer"))

    # Elsewhere: the first holder in the least other conversation, which is one of the two least that hold the passage.
    per = written(held.groupBy("h", "conv_id").agg(F.min(F.struct(F.col("seq").alias("to_seq"), F.col("turn").alias("to_turn"))).alias("x")).select("h", "conv_id", "x.*"))
    least = lambda name: F.min(F.struct(F.col("conv_id").alias("to_conv"), "to_seq", "to_turn")).alias(name)
    weight = F.count("*").alias("n")
    first = written(per.groupBy("h").agg(least("s"), weight))
    second = meet(per, first, ["h"], "n").where(F.col("conv_id") != F.col("s.to_conv")).groupBy("h").agg(least("s2"))
    both = first.drop("n").join(second, "h", "left").join(asked, "h")
    other = F.when(F.col("s.to_conv") != F.col("conv_id"), F.col("s")).otherwise(F.col("s2"))
    told = found.where("hit is null and telling").select("seq", "conv_id", "number", "level", "rank", "h")
    outer = meet(told, written(both), ["h"], "n").withColumn("o", other).where("o is not null")
    outer = outer.select("seq", "number", "level", "rank", "o.to_seq", "o.to_conv", "o.to_turn", F.lit(True).alias("outer"))
    # A whole passage is better evidence than its sentence, its own conversation than others.
    best = F.min(F.struct("rank", "outer", "to_seq", "to_conv", "to_turn")).alias("b")
    return written(inner.unionByName(outer).groupBy("seq", "number", "level").agg(best).select("seq", "number", "level", "b.to_seq", "b.to_conv", "b.to_turn", "b.outer"))


def parents(m: DataFrame, found: DataFrame) -> DataFrame:
    """``seq, conv_id, turn, n_linked, to_conv, to_turn, parent_seq, parent_conv, parent_turn`` of every message; written."""
    # Least deep passage, own conversation first, then the latest message.
    best = found.groupBy("seq").agg(F.min(F.struct("level", "outer", (-F.col("to_seq")).alias("minus"), "to_conv", "to_turn")).alias("b"), F.count("*").alias("n_linked"))
    best = best.select("seq", "n_linked", (-F.col("b.minus")).alias("to_seq"), "b.to_conv", "b.to_turn")
    # The turn before, among a conversation's distinct turns.
    turns = m.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
    turns = preceding(turns, ["conv_id", "turn"], F.struct("conv_id", "turn", "last")).where(F.col("before.conv_id") == F.col("conv_id"))
    turns = written(turns.select("conv_id", "turn", "n", F.col("before.turn").alias("back_turn"), F.col("before.last").alias("back_seq")))
    base = m.select("seq", "conv_id", "turn")
    kept = base.join(best, "seq", "left")
    small = turns.select("conv_id", "turn", "back_turn", "back_seq")
    kept = kept.join(small, ["conv_id", "turn"], "left")
    linked = F.col("to_seq") < F.col("seq")
    pick = lambda a, b: F.when(linked, F.col(a)).otherwise(F.col(b))
    own = F.when(F.col("back_seq").isNotNull(), F.col("conv_id"))
    return written(
        kept.select("seq", "conv_id", "turn", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "to_conv", "to_turn", pick("to_seq", "back_seq").alias("parent_seq"), F.when(linked, F.col("to_conv")).otherwise(own).alias("parent_conv"), pick("to_turn", "back_turn").alias("parent_turn"))
    )


def places(node: DataFrame) -> DataFrame:
    """``seq, root, n_thread, depth, position`` of a forest ``seq, parent_seq`` whose parents have smaller numbers.

    A message is entered at event 2 seq and left at 2 seq + 1. The last event of
    a tree is that its root is left; the entries up to there give the place, the
    entries less the leavings the depth.
    """
    child = node.where("parent_seq is not null").select("parent_seq", "seq")
    ahead = preceding(child, ["parent_seq", "seq"], F.struct("parent_seq", "seq"))
    following = ahead.where(F.col("before.parent_seq") == F.col("parent_seq")).select(F.col("before.seq").alias("seq"), F.col("seq").alias("next_reply"))
    first = child.groupBy(F.col("parent_seq").alias("seq")).agg(F.min(F.col("seq")).alias("first_reply"))
    shaped = node.select("seq", "parent_seq").join(first, "seq", "left").join(following, "seq", "left")
    entered, left = 2 * F.col("seq"), 2 * F.col("seq") + 1
    step = F.array(
        F.struct(entered.alias("e"), F.coalesce(2 * F.col("first_reply"), left).alias("to"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d")),
        F.struct(left.alias("e"), F.coalesce(2 * F.col("next_reply"), 2 * F.col("parent_seq") + 1, left).alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d")),
    )
    events = shaped.select(F.explode(step).alias("x")).select("x.*")
    over = F.col("e") == F.col("to")  # a root is left
    zero = lambda c: F.when(over, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    state = written(events.select("e", "to", zero("n"), zero("d"), over.alias("done")))
    done, active = state.where("done"), state.where("not done")
    while not active.isEmpty():
        up = active.unionByName(done).select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = written(active.join(up, "to").select("e", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done")))
        done, active = done.unionByName(moved.where("done")), moved.where("not done")
    entry = done.where(F.col("e") % 2 == 0).select(F.shiftright("e", 1).alias("seq"), F.shiftright("to", 1).alias("root"), F.col("n").alias("behind"), (1 - F.col("d")).alias("depth"))
    entry = written(entry)
    size = entry.where(F.col("seq") == F.col("root")).select("root", F.col("behind").alias("n_thread"))
    return meet(entry, size, ["root"], "n_thread").select("seq", "root", "n_thread", "depth", (F.col("n_thread") - F.col("behind")).alias("position"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Messages without quotes and their place: ``conv_id, turn, role, own, n_quotes, n_linked, to_conv, to_turn, parent_conv, parent_turn, depth, root_conv, root_turn, position``.

    Threads are the trees of roots; ``position`` counts from 0 in each. Several
    roots may share a conversation and turn.
    """
    m = messages(conversations)
    node = parents(m, links(m))
    placed = places(node)
    roots = node.where("parent_seq is null").select(F.col("seq").alias("root"), F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"))
    weighed = roots.join(placed.where(F.col("seq") == F.col("root")).select("root", "n_thread"), "root")
    shaped = meet(placed.drop("n_thread"), written(weighed), ["root"], "n_thread")
    quotes = F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("long")
    texts = m.select("seq", "role", "own", quotes.alias("n_quotes"))
    out = texts.join(node, "seq").join(shaped, "seq")
    return out.select("conv_id", "turn", "role", "own", "n_quotes", "n_linked", "to_conv", "to_turn", "parent_conv", "parent_turn", "depth", "root_conv", "root_turn", "position")


def oracle() -> str:
    """The query's rows in DuckDB SQL; trees are walked by a recursive query."""
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    sentence = lambda x: f"list_filter(list_transform(string_split_regex({x}, '{SENTENCE}'), lambda x: {norm('x')}), lambda x: x <> '')"
    return f"""
WITH RECURSIVE m AS (
    SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS seq, conv_id, turn, role, text,
           string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM conversations),
raw AS (SELECT seq, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m),
marked AS (SELECT *, regexp_extract(line, '{MARKS}', 1) AS marks FROM raw),
lines AS (SELECT seq, i, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS body FROM marked),
near AS (
    SELECT *, trim(body, ' ') = '' AS blank, coalesce(lead(level) OVER w, 0) AS next_level, lag(level) OVER w AS last_level,
           lag(trim(body, ' ') = '') OVER w AS last_blank FROM lines WINDOW w AS (PARTITION BY seq ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN last_level = level AND NOT last_blank THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY i) AS run FROM near),
parts AS (
    SELECT seq, level, string_agg(body, chr(10) ORDER BY i) AS text, row_number() OVER (PARTITION BY seq ORDER BY min(i)) - 1 AS number
    FROM runs WHERE NOT blank GROUP BY seq, run, level),
joined AS (
    SELECT seq, string_agg(body, chr(10) ORDER BY i) AS t FROM near
    WHERE level = 0 AND NOT (regexp_matches(body, '{INTRO}') AND next_level > 0) GROUP BY seq),
own AS (SELECT m.seq, regexp_replace(regexp_replace(coalesce(t, ''), '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS own FROM m LEFT JOIN joined USING (seq)),
named AS (SELECT seq, conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
cut AS (SELECT seq, number, level, {norm('text')} AS whole, {sentence('text')} AS ss FROM parts WHERE level > 0),
long AS (SELECT seq, number, s FROM (SELECT seq, number, unnest(ss) AS s, generate_subscripts(ss, 1) AS k, len(ss) AS n FROM cut)
         WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY seq, number ORDER BY length(s) DESC, k) = 1),
quoted AS (
    SELECT * FROM (SELECT seq, number, level, 0 AS rank, whole AS key FROM cut UNION ALL SELECT c.seq, c.number, level, 1, s FROM cut c JOIN long USING (seq, number))
    JOIN named USING (seq) WHERE key <> '' AND (rank = 0 OR length(key) >= {MIN_CHARS})),
units AS (
    SELECT seq, {norm('own')} AS key FROM own UNION SELECT seq, {norm('text')} FROM parts WHERE level = 0
    UNION SELECT seq, unnest({sentence('text')}) FROM parts WHERE level = 0),
held AS (SELECT * FROM units JOIN named USING (seq) WHERE key <> ''),
inside AS (
    SELECT q.seq, q.number, q.level, q.rank, max(h.seq) AS to_seq FROM quoted q JOIN held h ON h.key = q.key AND h.conv_id = q.conv_id AND h.turn < q.turn GROUP BY ALL),
outside AS (
    SELECT q.seq, q.number, q.level, q.rank, min(h.seq) AS to_seq
    FROM quoted q JOIN held h ON h.key = q.key AND h.conv_id <> q.conv_id
    WHERE length(q.key) >= {MIN_CHARS} AND (q.seq, q.number, q.rank) NOT IN (SELECT (seq, number, rank) FROM inside) GROUP BY ALL),
links AS (
    SELECT seq, number, level, outer_, to_seq FROM (SELECT *, 0 AS outer_ FROM inside UNION ALL SELECT *, 1 FROM outside)
    QUALIFY row_number() OVER (PARTITION BY seq, number ORDER BY rank, outer_) = 1),
best AS (
    SELECT seq, to_seq, count(*) OVER (PARTITION BY seq) AS n_linked FROM links
    QUALIFY row_number() OVER (PARTITION BY seq ORDER BY level, outer_, to_seq DESC) = 1),
turns AS (SELECT conv_id, turn, lag(max(seq)) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
node AS (
    SELECT m.seq, m.conv_id, m.turn, coalesce(n_linked, 0) AS n_linked, to_seq, CASE WHEN to_seq < m.seq THEN to_seq ELSE back END AS parent
    FROM m LEFT JOIN best USING (seq) LEFT JOIN turns USING (conv_id, turn)),
tree AS (
    SELECT seq, seq AS root, 0 AS depth, [seq] AS path FROM node WHERE parent IS NULL
    UNION ALL SELECT n.seq, t.root, t.depth + 1, list_append(t.path, n.seq) FROM node n JOIN tree t ON n.parent = t.seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position FROM tree)
SELECT m.conv_id, m.turn, m.role, own.own, (SELECT count(*) FROM parts p WHERE p.seq = m.seq AND level > 0) AS n_quotes, node.n_linked,
       t.conv_id AS to_conv, t.turn AS to_turn, p.conv_id AS parent_conv, p.turn AS parent_turn, placed.depth, r.conv_id AS root_conv, r.turn AS root_turn, placed.position
FROM m JOIN own USING (seq) JOIN node USING (seq) JOIN placed USING (seq) JOIN m r ON r.seq = placed.root
LEFT JOIN m t ON t.seq = node.to_seq LEFT JOIN m p ON p.seq = node.parent"""

"""Text functions of chunks, previews, lines and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
#: Start of layer namespaces; it names a vocabulary, so it is a parameter of ``layer_of``.
URN = "urn:layers:"
#: Layers by short and long name.
LAYER_ALIASES = {
    "terminology": "trm",
    "prose": "pr",
    "organization": "org",
    "relation": "rel",
    "decision": "dec",
    "source": "src",
    "plan": "pln",
    "artifact": "art",
    "revision": "rev",
    "llm": "llm",
    "index": "idx",
}
#: How much an edge to a neighbour counts, by relation type.
EDGE_PRIORITY = {"implements": 6, "depends-on": 5, "refines": 4, "precedes": 3, "constrains": 2, "references": 1}
NO_PEEK = "(no peek available)"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ELLIPSIS))).otherwise(text)


def preview(text: Column, n: int = 600) -> Column:
    """The text without its first line, white space collapsed, cut with an ellipsis."""
    return truncated(collapsed(F.regexp_replace(text, r"^[^\n]*\n?", "")), n)


def layer_of(namespace: Column, urn: str = URN) -> Column:
    return F.when(namespace.startswith(urn), F.substring(namespace, len(urn) + 1, 1000)).otherwise(namespace)


def chunk_text(layer: Column, names: Column, text: Column) -> Column:
    """A header with layer and path, a newline, the trimmed text."""
    return F.concat(F.lit("[layer="), F.when(F.coalesce(layer, F.lit("")) == "", "?").otherwise(layer), F.lit(" path="), F.array_join(names, ">"), F.lit("]\n"), F.trim(text))


def lines(text: Column) -> Column:
    """Lines without an empty one behind a final newline."""
    parts = F.split(text, "\n")
    return F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)


def line_range(text: Column, start: Column | int, end: Column | int) -> Column:
    """Lines start to end (from 1, inclusive, cut to the text), joined; empty where the text ends before."""
    all_lines = lines(text)
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    n = F.least(end, F.size(all_lines)) - start + 1
    return F.when(n > 0, F.array_join(F.slice(all_lines, start, F.greatest(n, F.lit(1))), "\n")).otherwise(F.lit(""))


def filled_lines(text: Column) -> Column:
    """How many lines hold more than white space."""
    return F.size(F.filter(lines(text), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))


def strength(line_count: Column) -> Column:
    return F.when(line_count <= 30, "precise").when(line_count <= 100, "moderate").otherwise("broad")


def edge_score(kind: Column, relation: Column) -> Column:
    priority = reduce(lambda rest, kv: F.when(relation == kv[0], kv[1]).otherwise(rest), EDGE_PRIORITY.items(), F.lit(0))
    return F.when(kind == "relation", 100 + priority).when(kind == "artifact-map", 90).otherwise(10)


def peek(*choices: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices], F.lit(NO_PEEK))


def in_layer(layer: Column, wanted: str) -> Column:
    """Whether a row's layer is the wanted one, by short or long name."""
    other = {**LAYER_ALIASES, **{v: k for k, v in LAYER_ALIASES.items()}}.get(wanted)
    return layer.isin(*[x for x in (wanted, other) if x])


def path_shingles(parts: Column) -> Column:
    """Runs of three path parts (of all, if fewer), and every single part."""
    n = F.size(parts)
    runs = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, 3), "/"))).when(n == 2, F.array(F.array_join(parts, "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(runs, parts)


def xml_escaped(text: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if attribute else [])
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


#: Languages of code by file ending.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "xml": "xml", "xsd": "xml", "sh": "bash", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown"}


def language_of(path: Column) -> Column:
    """Language of a file by its ending; null where the ending is not known."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, broken between words; a longer word stands alone."""

    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= width
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line"))).when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["line"], w).alias("line"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), w.alias("line")))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


def matches_any(path: Column, *parts: str) -> Column:
    """Whether a path holds one of the parts; no parts match every path."""
    return reduce(lambda a, b: a | b, [path.contains(p) for p in parts]) if parts else F.lit(True)


def is_exempt(target: Column, to_spec: Column | None = None) -> Column:
    """Whether a reference needs no target here: ids of types, and relations into other specs."""
    own = target.startswith("type-")
    return own | to_spec.isNotNull() if to_spec is not None else own


def short_layer(layer: Column) -> Column:
    """Short name of a layer; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYER_ALIASES.items() for x in kv]), layer)


def branch_ref(name: Column) -> Column:
    return F.concat(F.lit("refs/heads/"), name)


def tag_ref(name: Column) -> Column:
    return F.concat(F.lit("refs/tags/"), name)


def remote_kind(url: Column) -> Column:
    """``websocket`` or ``file``."""
    return F.when(url.rlike("^wss?://"), "websocket").otherwise("file")


def total_size(*parts: Column) -> Column:
    """Sum of sizes, missing ones as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


def number_after(text: Column, name: str) -> Column:
    """The first whole number behind ``"name":`` or ``name:`` in a text; null where there is none."""
    return F.regexp_extract(text, rf'"?{name}"?\s*:\s*([0-9]+)', 1).try_cast("long")


def timestamp_text(ts: Column) -> Column:
    """Seconds in UTC as the store writes them (the session's time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

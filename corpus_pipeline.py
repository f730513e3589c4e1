"""The corpus pipeline: toxic documents go, boilerplate lines go, one of each group of near copies stays, leaked benchmark texts go, the rest is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next stage's documents. All but the last return
the columns of the documents, whatever further ones there are. A null text counts
as a text without words. Rows are judged one by one: of a repeated id each by its
own text, and rows that are repeated as a whole stand or fall together. A row
without a doc_id takes part; as a near copy it goes where a row with an id has its
content. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import hyperminhash, line_spread, toxicity_crf, unigram, winnow
from lamina.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_crf.train(docs, table(spark, sf_dir, "labels"))
    prefix = "tox_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    scored = toxicity_crf.score(docs, model, keep=tuple(docs.columns), prefix=prefix)
    return scored.where(F.col(f"{prefix}score") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_spread.remove_boilerplate(docs)
    changed = F.col(cleaned.columns[-1]) > 0
    sized = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cleaned.select(*[sized.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.cleaned(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = unigram.encode_frame(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: No SQL: a trained classifier, sketches and a trie. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

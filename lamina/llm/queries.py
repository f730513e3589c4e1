"""Registered queries of the corpus operators: thin calls that derive the contracted columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import chroma, html_mincut, hyperminhash, line_spread, pii_bootstrap, quote_links, secret_entropy, toxicity_crf, unigram, winnow
from lamina.llm.common import ROW, table, written


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_crf.score(docs, model)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is read as a short mono recording; queries are the ids divisible by 100, against all rows: every link between classes, and the members of all classes."""
    prints = written(chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return chroma.links(prints, prints.where(F.col("rec_id") % 100 == 0))


def op3_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = unigram.encode_frame(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", "round_trip", "ids")


def op4_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_entropy.report(table(spark, sf_dir, "documents"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.report(table(spark, sf_dir, "documents"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), hundredths=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.reply_ordered(table(spark, sf_dir, "conversations"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*ROW)


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(table(spark, sf_dir, "documents"))


def op10_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_crf": op1_toxicity_crf,
        "op2_chroma": op2_chroma,
        "op3_unigram": op3_unigram,
        "op4_secret_entropy": op4_secret_entropy,
        "op5_line_spread": op5_line_spread,
        "op6_hyperminhash": op6_hyperminhash,
        "op7_quote_links": op7_quote_links,
        "op8_winnowing": op8_winnowing,
        "op9_pii_bootstrap": op9_pii_bootstrap,
        "op10_html_mincut": op10_html_mincut,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_entropy": secret_entropy.oracle(),
        "op5_line_spread": line_spread.oracle(),
        "op6_hyperminhash": hyperminhash.oracle(),
        "op7_quote_links": quote_links.oracle(),
        "op8_winnowing": winnow.oracle(),
    }

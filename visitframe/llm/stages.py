"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame, all but the last with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import settle_table
from visitframe.llm import kneser_ney, line_dedup, mixing, packing, simhash


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text (labelled good and not toxic); the rejected ones go."""
    return kneser_ney.keep_good(docs, kneser_ney.trusted_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over a tenth of a source's documents hold go; n_chars follows the text."""
    out = line_dedup.drop_site_lines(docs, "source", "text", ratio=0.1, least_pages=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints stays: three-word shingles, two bits, as in op2."""
    return simhash.keep_first(docs)


def mixing_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece with its ids."""
    # earlier stages' Python workers have memory of their own still, so words and shards are fewer here
    pieces = packing.pack_documents(docs.select("doc_id", "text"), keep=100_000, step=128, shard_rows=4_000)
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies),
          ("mixing sources", mixing_weights), ("packing", packed)]


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

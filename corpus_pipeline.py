"""The corpus pipeline: documents through five stages of sluice.llm, in this order."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import langid, lines, mixing, packing, shingles, simhash
from sluice.llm.common import dropped, kept, load


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language the corpus' own labels teach go."""
    return langid.recognised(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one; n_chars follows."""
    name = "_found"
    while name in docs.columns:
        name += "_"
    out = lines.drop_shared_lines(docs, found=name)
    text, kept = F.col("text"), F.col(name)["kept"]
    text = F.when(text.isNull() & (kept == ""), text).otherwise(kept)
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts with Jaccard similarity 0.8 or more of five-word shingles."""
    return simhash.one_of_each(docs, found=shingles.near_copies(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", recognise_language),
    ("line_dedup", drop_shared_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]
#: Fingerprints, fitted likelihoods and token ids have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, kept(partial(stage, spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)

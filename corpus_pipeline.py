"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryloom.llm import bpe, exact_dedup, langid, minhash, mixing
from juryloom.llm.common import bounded, materialize, shared_dir, table

#: Below it a text's n-grams stand like those of no learned language.
LEAST_LANGUAGE_SCORE = 0.05
#: Least similarity of near copies on word shingles; op7_minhash alone has its own, 85.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, those without letters, and those like no language's profile, go; equal rows go alike."""
    profiles = langid.learn(docs.filter(~langid.held_out(docs["doc_id"])))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), langid.prediction(docs["text"], profiles).alias("found"))
    known = (F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)
    return rows.filter(known).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without separators stays; null texts count as empty.

    Also of rows that are equal in all columns just one stays. A null doc_id comes after all others.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of near copies stays, with all rows of that doc_id.

    Texts without words and rows of null doc_id link with nothing and stay.
    """
    near = minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter("not kept").select("doc_id").distinct()
    gone = bounded(materialize(near, shared_dir(spark), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go by the rates that give the domains their target shares, equal rows alike.

    Null text has no tokens and goes by the rate of an unknown text.
    """
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row: doc_id, n_tokens and digests; null text has no tokens."""
    return bpe.encode_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]

#: The language profiles, the fitted rates and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
    return docs

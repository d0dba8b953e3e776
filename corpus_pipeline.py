"""A corpus from raw documents: language, exact and near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import bpe, exact_dedup, langid, mixing, near_dedup
from vellumine.llm.common import materialise, scratch, shared_root, table


#: Pre-tokens of a block in the last stage: fewer than by default, as executors still hold memory of the stages before.
BLOCK_TOKENS = 1_000_000


def _aside(docs: DataFrame, names: set[str]) -> DataFrame:
    """``docs`` with the columns that an operator would replace out of its way."""
    return docs.withColumnsRenamed({c: f"__x_in_{c}" for c in docs.columns if c in names})


def _back(found: DataFrame, columns: list[str], names: set[str]) -> DataFrame:
    """The columns of the documents as they came."""
    return found.select(*(F.col(f"__x_in_{c}" if c in names else c).alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt: others, and texts like none of them, are rejected.

    A document stays if it has a letter and its cosine with the predicted language isn't below the
    floor that labelled documents of its size set.  A document without a language gets the predicted one.

    Null and empty texts go; repeated rows meet one decision; whole texts are read; without
    labelled rows every document is ``und``; an empty table stays empty; further columns of
    any name, those of the prediction included, are passed on as they came.
    """
    own = {"lang_pred", "score", "size"}
    labelled = docs.where(F.col("lang").isNotNull())
    model = langid.fit(labelled)
    least = langid.floors(langid.predict(labelled.select("text"), model, size_col="size"))
    found = langid.predict(_aside(docs, own).withColumn("__x_text", F.col("text")), model, "__x_text", "size")
    found = found.where((F.col("lang_pred") != "und") & langid.alike(least, F.col("score"), F.col("size")))
    return _back(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns, own)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest identifier.

    Null and empty texts are one text; of fully equal rows one stays; null identifiers sort
    below all others; an empty table stays empty; further columns of any name are passed on.
    """
    own = {"keep_id", "group_size", "kept", "text_sha256", "keep_locator"}
    return _back(exact_dedup.exact_dedup(_aside(docs, own)).where("kept"), docs.columns, own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest identifier.

    Texts without a word are near to equal ones only; rows equal in identifier and text stay
    together; an empty table stays empty; further columns of any name are passed on.
    """
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents resampled to the target weights: each appears as often as its rate has it.

    Null and empty texts have the rate of the prior; without labels all documents are alike;
    repeated rows have equal rates; an empty table stays empty; further columns of any name are
    passed on.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to.

    Null and empty texts have no ids; repeated rows are encoded each; whole texts are encoded;
    an empty table gives an empty result; further columns are ignored.
    """
    return bpe.encode_decode(docs, with_ids=True, block_tokens=BLOCK_TOKENS).select("doc_id", "n_tokens", "token_ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: Language vectors, sampling, rates and merges are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage leaves behind goes when it has been written."""
    docs, home = table(spark, sf_dir, "documents"), shared_root(spark)
    for number, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"{home}/{number}-{name}")
    return docs

"""Canonical exact fingerprints of documents.

A text is brought to canonical form (NFKC, case folding, runs of white space to one space,
trimmed) and hashed with 128-bit xxhash.  Documents with equal hashes form a bucket, inside
which canonical bytes are compared: should a bucket ever hold different canonical texts, all
but the first of them (in byte order) get a numbered suffix, so that equal fingerprints mean
equal canonical texts.  The likeness of two fingerprints is 1 if their canonical texts are
equal and 0 otherwise.

For the drift report each document is also compared with an edited copy of itself, whose last
third is taken from the start of the next document in descending order of identifier, and
with that next document.  Neighbours are found in ranges of identifiers; each range also gets
the largest document of the range below, so no range has to see another.

Edge cases: a null text counts as empty; null identifiers sort below all others; equal
identifiers are ordered by text; the document after the last is the first, so a single
document is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, partitions, ship, shared_root, small_or_shuffled

#: Ranges of identifiers for each shuffle partition.
RANGES_PER_PARTITION = 8
#: Quantiles of the identifiers between which ranges have equal width.
SEGMENTS = 64
LIKENESS = T.StructType(
    [
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def canonical_text(text: str | None) -> str:
    """The canonical form of a text."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


@F.pandas_udf(T.StringType())
def digest(texts: pd.Series) -> pd.Series:
    """128-bit xxhash of the canonical form, as 32 hexadecimal digits."""
    return texts.map(lambda t: xxhash.xxh3_128_hexdigest(canonical_text(t).encode("utf-8", "surrogatepass")))


@F.pandas_udf(LIKENESS)
def _likeness(texts: pd.Series, edited: pd.Series, twin: pd.Series) -> pd.DataFrame:
    """twin: the next document's text where its hash equals this one's, else null."""
    rows = []
    for text, other, following in zip(texts, edited, twin, strict=True):
        own, changed = canonical_text(text), canonical_text(other)
        rows.append(
            (
                xxhash.xxh3_128_hexdigest(changed.encode("utf-8", "surrogatepass")),
                float(own == changed),
                float(following is not None and own == canonical_text(following)),
            )
        )
    return pd.DataFrame(rows, columns=["edited_fingerprint", "near_edited", "near_next"])


def _sha(text: Column) -> Column:
    """A name of a text: rows of equal texts share it whatever their identifiers."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row of any table: the plain operator."""
    ship(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = keyed.select("doc_id", _sha(F.col("text")).alias("sha"), digest("text").alias("fingerprint"))
    return resolve_buckets(materialise(marked, shared_root(docs.sparkSession)), keyed).drop("sha")


def resolve_buckets(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Compare canonical bytes inside equal buckets of ``marked`` (materialised sha, fingerprint, …).

    ``texts``: the texts of the same rows.  Rows meet by the hash of their text, never by
    their identifier, which may be null or repeat.
    """
    home = shared_root(marked.sparkSession)
    pairs = materialise(marked.groupBy("sha", "fingerprint").agg(F.count(F.lit(1)).alias("n")), f"{home}/pairs")
    shared = pairs.groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1").select("fingerprint")
    shared = small_or_shuffled(materialise(shared, f"{home}/shared"))
    members = materialise(pairs.join(shared, "fingerprint").select("sha", "fingerprint"), f"{home}/members")
    keyed = texts.select(_sha(F.col("text")).alias("sha"), "text")
    inside = keyed.join(small_or_shuffled(members), "sha").select("sha", "fingerprint", canonical("text").alias("canonical"))
    mixed = inside.groupBy("fingerprint").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high")).where("low < high")
    mixed = materialise(mixed.select("fingerprint"), f"{home}/mixed")
    if mixed.isEmpty():
        return marked
    # a collision of 128-bit hashes: the different canonical texts of a bucket are numbered
    other = materialise(inside.join(mixed, "fingerprint").distinct(), f"{home}/other")
    other = other.withColumn("k", F.dense_rank().over(W.partitionBy("fingerprint").orderBy("canonical"))).where("k > 1").select("sha", "k")
    return (
        marked.join(small_or_shuffled(materialise(other.distinct(), f"{home}/numbered")), "sha", "left")
        .withColumn("fingerprint", F.concat("fingerprint", F.coalesce(F.concat(F.lit("-"), "k"), F.lit(""))))
        .drop("k")
    )


def _range_of(docs: DataFrame, key: Column, count: int) -> Column:
    """The number of a document's range of identifiers; grows with the identifier."""
    cuts = docs.agg(F.percentile_approx(key, [i / SEGMENTS for i in range(SEGMENTS + 1)], 10000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or [0]))
    inner = max(1, count // max(1, len(cuts) - 1))
    expr = F.lit(0)
    for number, (low, high) in enumerate(zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)):
        share = F.least(F.lit(inner - 1), F.floor((key - F.lit(low)).cast("double") * (inner / (high - low))))
        expr = F.when(key >= F.lit(low), F.lit(number * inner) + share).otherwise(F.lit(0)) if number == 0 else F.when(
            key >= F.lit(low), F.lit(number * inner) + share
        ).otherwise(expr)
    return expr.cast("bigint")


def drift(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited copies, with likenesses."""
    spark = docs.sparkSession
    ship(spark)
    home = shared_root(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**62)))
    where = _range_of(base.select("doc_id"), key, RANGES_PER_PARTITION * partitions(spark))
    # as many rows as there are ranges
    tops = base.select(where.alias("range"), key.alias("key")).groupBy("range").agg(F.max("key").alias("key"))
    above = W.orderBy("range")
    needs = tops.select("key", F.lead("range").over(above).alias("above"), F.min("range").over(W.partitionBy()).alias("lowest"))
    needs = materialise(needs.select("key", F.coalesce("above", "lowest").alias("needed")), f"{home}/tops")
    rows = (
        base.withColumns({"key": key, "range": where, "fingerprint": digest("text")})
        .join(small_or_shuffled(needs), "key", "left")
        .withColumn(
            "to",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
                        F.struct(F.col("needed").alias("range"), F.lit(True).alias("guest")),
                    ),
                    lambda x: x["range"].isNotNull(),
                )
            ),
        )
        .select("doc_id", "text", "key", "fingerprint", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))
    )
    order = W.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).where("not guest")
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 3)"), F.substring("next_text", F.lit(1), third)))
    rows = rows.select(
        "doc_id",
        _sha(F.col("text")).alias("sha"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        _likeness("text", "edited", F.when(F.col("fingerprint") == F.col("next_fingerprint"), F.col("next_text"))).alias("x"),
    ).select("doc_id", "sha", "n_chars", "edited_sha256", "fingerprint", "x.edited_fingerprint", "x.near_edited", "x.near_next")
    return resolve_buckets(materialise(rows, f"{home}/rows"), base).drop("sha")

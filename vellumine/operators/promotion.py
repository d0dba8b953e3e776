"""Promotion of candidates to the stable pool until its targets are met.

Candidates come in the order of a score that is worked out from the counters as they stand
before.  One after another is promoted, unless its article has reached its cap, until the pool is
large enough and every type is covered often enough.  What this walk promotes can be told without
walking:

* An article's cap depends on its own candidates alone: of each article the best ``cap`` minus the
  stable ones pass, whatever happens elsewhere.
* Those that pass are promoted from the first to some last one.  The walk ends where all targets are
  met; each target by itself is met at one place: the pool's at the n-th that passes, a type's at the
  n-th that covers it, n being what is missing.  The last one is the latest of these places; if one
  is never met, all that pass are promoted.

So the walk is a rank within articles, and a rank within types of which only the first n count.  The
targets bound what the ranks keep; nothing else is gathered, and the driver sees nothing.

Edge cases: candidates without a type are never promoted; null scores stand last; equal scores go by
identifier; targets already met promote nobody; an empty table promotes nobody.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of the score, bonuses of types.
QUALITY, FLAG, ARTICLE, SOURCE = 2.0, 0.05, 0.10, 0.01
BONUS = {"sentence_order": 0.35, "sentence_fill": 0.30, "continuation": 0.40}


def counters(stable: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stable materials (article_id, source, types) by article, source and type."""
    by = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}"))
    return by(stable, "article_id"), by(stable, "source"), by(stable.select(F.explode("types").alias("type")), "type")


def scored(gray: DataFrame, stable: DataFrame, types: Sequence[str], per_type: int, least: float) -> DataFrame:
    """Candidates (id, article_id, source, types, quality, n_flags) with their score and what is stable of their article.

    A candidate below the least quality stays only while one of its types is missing.
    """
    articles, sources, kinds = counters(stable)
    # one row: how often each of the few types is covered
    covered = kinds.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("type", "n_type"))).alias("covered"))
    rows = gray.where(F.size("types") > 0).join(articles, "article_id", "left").join(sources, "source", "left").crossJoin(F.broadcast(covered))
    lacking = F.transform("types", lambda t: F.greatest(F.lit(0), F.lit(per_type) - F.coalesce(F.try_element_at("covered", t), F.lit(0))))
    missing = F.aggregate(lacking, F.lit(0).cast("long"), lambda acc, x: acc + x)
    score = F.coalesce("quality", F.lit(0.0)) * QUALITY + missing / max(per_type, 1) - F.col("n_flags") * FLAG
    for name, bonus in BONUS.items():
        score = score + F.when(F.array_contains("types", name), bonus).otherwise(0.0)
    score = score - F.coalesce("n_article_id", F.lit(0)) * ARTICLE - F.coalesce("n_source", F.lit(0)) * SOURCE
    kept = (F.coalesce("quality", F.lit(0.0)) >= least) | (missing > 0)
    return rows.where(kept).withColumns({"score": F.round(score + 1e-9, 6), "n_article": F.coalesce("n_article_id", F.lit(0))}).drop("n_article_id", "n_source", "covered")


def promoted(gray: DataFrame, stable: DataFrame, types: Sequence[str], target: int, per_type: int, cap: int, least: float) -> DataFrame:
    """(id, article_id, types, score) of the candidates that the walk promotes."""
    rows = scored(gray, stable, types, per_type, least)
    order = (F.desc_nulls_last("score"), F.asc("id"))
    place = F.row_number().over(W.partitionBy("article_id").orderBy(*order))
    passed = rows.withColumn("place", place).where(F.col("place") <= cap - F.col("n_article")).select("id", "article_id", "types", "score")
    key = F.struct((-F.col("score")).alias("by"), F.col("id").alias("id"))
    _, _, kinds = counters(stable)
    wanted = stable.sparkSession.createDataFrame([(t,) for t in types], "type string").join(kinds, "type", "left")
    wanted = wanted.select("type", (F.lit(per_type) - F.coalesce("n_type", F.lit(0))).alias("missing")).where("missing > 0")
    # the place at which each missing type is covered: its missing-th candidate; null if there are too few
    of_type = passed.select(key.alias("key"), F.explode("types").alias("type")).join(F.broadcast(wanted), "type")
    ranked = of_type.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy("key"))).where(F.col("rank") <= per_type)
    met = wanted.join(ranked.where("rank = missing").select("type", "key"), "type", "left").select("key")
    # and the place at which the pool is large enough
    short = stable.groupBy().agg((F.lit(target) - F.count(F.lit(1))).alias("missing"))
    first = passed.select(key.alias("key")).orderBy("key").limit(max(target, 1))
    filled = first.withColumn("rank", F.row_number().over(W.orderBy("key")))
    filled = short.where("missing > 0").join(filled, filled["rank"] == short["missing"], "left").select("key")
    ends = met.unionByName(filled).groupBy().agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("n_met"), F.max("key").alias("last"))
    out = passed.withColumn("key", key).crossJoin(F.broadcast(ends))
    return out.where((F.col("n") > 0) & ((F.col("n_met") < F.col("n")) | (F.col("key") <= F.col("last")))).select("id", "article_id", "types", "score")

"""Sources and sinks: article tables, annotation CSV, export packs, replace-by-article writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of annotations with a header; malformed rows become nulls."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def by_url(articles: DataFrame, urls: DataFrame, known: bool) -> DataFrame:
    """Articles whose URL is among ``urls`` (known) or not yet (fresh)."""
    return articles.join(urls.select("url"), "url", "left_semi" if known else "left_anti")


def replace_by_article(old: DataFrame, new: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows of articles that have new rows are replaced by those."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def export_pack(materials: DataFrame) -> DataFrame:
    """Materials fit to leave: not rejected or deprecated; stable first, then by quality and id."""
    kept = materials.where(~F.coalesce(F.col("status"), F.lit("")).isin("rejected", "deprecated"))
    return kept.select("*", F.when(F.col("channel") == "stable", 0).otherwise(1).alias("place"), T.preview(F.col("text"), 200).alias("preview"))


def write_pack(materials: DataFrame, folder: str) -> None:
    """The pack as JSON lines and CSV in export order, and its counts by status and channel."""
    pack = export_pack(materials).orderBy("place", F.desc("quality"), "id").drop("place")
    pack.write.mode("overwrite").json(f"{folder}/jsonl")
    pack.select("id", "status", "channel", "quality", "preview").write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    pack.groupBy("status", "channel").count().write.mode("overwrite").json(f"{folder}/summary")


def markdown(items: DataFrame, by: str, title: str, body: str) -> DataFrame:
    """A Markdown section per row, to be written in order of (by, title)."""
    section = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"))
    return items.select(by, title, section.alias("value"))

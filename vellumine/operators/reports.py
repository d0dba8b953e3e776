"""Reports: card coverage, anchors, grouped measures, and query terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms that are ranked, and that are kept; least and most characters of a clause taken whole, and sizes of the pieces of longer ones.
RANKED, KEPT = 16, 8
SHORT = (3, 8)
PIECES = (4, 5, 6)


def card_coverage(targets: DataFrame, uses: DataFrame) -> DataFrame:
    """targets (card, target) with n, stable and gap, the stable materials that a card still lacks; cards without any use count 0."""
    used = uses.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("stable"))
    out = targets.join(used, "card", "left").na.fill(0, ["n", "stable"])
    return out.withColumn("gap", F.greatest(F.lit(0), F.col("target") - F.col("stable")))


def anchors(rows: DataFrame, samples: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """``rows`` with the first k sample_id of their key, and whether the key is covered; samples are a small table of annotations."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("sample_id"))
    first = samples.withColumn("place", place).where(F.col("place") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("sample_id")).alias("anchors"))
    out = rows.join(first, list(keys), "left").withColumn("covered", F.col("anchors").isNotNull())
    return out.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<bigint>")))


def measures(records: DataFrame, by: Sequence[str], counts: Mapping[str, str], means: Mapping[str, str], tails: Mapping[str, str], share: float) -> DataFrame:
    """Counts, means and percentiles of each grouping in ``by``, all in one pass; groups without a value have 0."""
    c = F.col
    aggregates = [F.expr(e).alias(n) for n, e in counts.items()]
    aggregates += [T.rounded(F.coalesce(F.avg(F.expr(e)), F.lit(0.0)), 4).alias(n) for n, e in means.items()]
    aggregates += [T.rounded(F.coalesce(F.percentile(F.expr(e), F.lit(share)), F.lit(0.0)), 4).alias(n) for n, e in tails.items()]
    return records.groupingSets([(c(x),) for x in by], *(c(x) for x in by)).agg(*aggregates)


def heaviest_terms(terms: DataFrame, by: str, k: int = RANKED) -> DataFrame:
    """The k heaviest of (by, term, weight); ties by term.  Weights are summed before any group is ranked."""
    total = terms.groupBy(by, "term").agg(F.sum("weight").alias("weight"))
    return total.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= k)


def mined_terms(texts: DataFrame, by: str, stop: Sequence[str] = ()) -> DataFrame:
    """(by, terms): up to ``KEPT`` of the ``RANKED`` heaviest terms, none of which holds, or is held by, a heavier one.

    A clause of letters counts twice if it is short; of a longer one each piece of four to six letters counts once.
    """
    clauses = texts.select(by, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("clause"))
    n = F.length("clause")

    def cut(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring("clause", i, F.lit(size)))

    pieces = F.flatten(F.array(*map(cut, PIECES)))
    whole = F.array(F.struct(F.col("clause").alias("term"), F.lit(2).alias("weight")))
    parts = F.transform(pieces, lambda p: F.struct(p.alias("term"), F.lit(1).alias("weight")))
    rows = clauses.where(n >= SHORT[0]).select(by, F.explode(F.when(n <= SHORT[1], whole).otherwise(parts)).alias("x")).select(by, "x.*")
    if stop:
        rows = rows.where(~F.col("term").isin(*stop))
    # at most RANKED rows of each group
    ranked = heaviest_terms(rows, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("r"))
    kept = F.aggregate(
        F.transform("r", lambda x: x["term"]), F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) >= KEPT) | F.exists(acc, lambda y: y.contains(x) | x.contains(y)), acc).otherwise(F.array_append(acc, x)),
    )
    return ranked.select(by, F.array_join(kept, ",").alias("terms"))

#: Words of reference items that are broadcast, at most; beyond it they are joined by a shuffle.
MOST_WORDS = 200_000


def nearest_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, support) of the item whose words a document covers best; the smallest item of equals, none without a shared word.

    docs: (doc_id, words), items: (item_id, words), words distinct.  The words of up to ``MOST_WORDS`` are broadcast, so that
    counts of a document and an item are summed where the document is; frequent words still make many such counts.
    """
    y = items.select("item_id", F.size("words").alias("n"), F.explode("words").alias("w"))
    if y.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        y = F.broadcast(y)
    pairs = docs.select("doc_id", F.explode("words").alias("w")).join(y, "w").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    best = pairs.groupBy("doc_id").agg(F.min(F.struct((-F.col("shared") / F.col("n")).alias("by"), "item_id", "shared")).alias("b"))
    return best.select("doc_id", "b.item_id", "b.shared", F.round(-F.col("b.by"), 4).alias("support"))

"""Threshold grids, policies, review queues and active learning."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def threshold_grid(records: DataFrame, finals: list[float], readiness: list[float], penalties: list[float]) -> DataFrame:
    """Every scenario of every family in one pass over the records.

    ``records``: (family, final, readiness, penalty, positive).  A scenario keeps a record with
    final and readiness at least, penalty at most.  Records are counted by how many thresholds
    each of their scores reaches, which leaves a bounded number of cells for each family; the
    scenarios are sums over cells, so records are never multiplied.
    """
    finals, readiness, penalties = sorted(finals), sorted(readiness), sorted(penalties)

    def bin_of(x: Column, cuts: list[float]) -> Column:
        """How many thresholds a score reaches."""
        return sum((F.when(x >= cut, 1).otherwise(0) for cut in cuts[1:]), F.when(x >= cuts[0], 1).otherwise(0))

    # a penalty is above so many of the greatest penalties, and then none of the lower ones keeps it
    above = sum((F.when(F.col("penalty") > cut, 1).otherwise(0) for cut in penalties[1:]), F.when(F.col("penalty") > penalties[0], 1).otherwise(0))
    null = F.col("final").isNull() | F.col("readiness").isNull() | F.col("penalty").isNull()
    cells = records.groupBy(
        "family", F.when(~null, bin_of(F.col("final"), finals)).alias("f"), F.when(~null, bin_of(F.col("readiness"), readiness)).alias("r"), F.when(~null, above).alias("p")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("positives"))
    grid = F.array(
        *(
            F.struct(F.lit(f).alias("final_min"), F.lit(r).alias("readiness_min"), F.lit(p).alias("penalty_max"), F.lit(i).alias("f"), F.lit(j).alias("r"), F.lit(k).alias("p"))
            for (i, f), (j, r), (k, p) in product(enumerate(finals, 1), enumerate(readiness, 1), enumerate(penalties))
        )
    )
    # few cells of each family meet all scenarios; a cell without its scores is kept by none
    kept = (F.col("f") >= F.col("x.f")) & (F.col("r") >= F.col("x.r")) & (F.col("p") <= F.col("x.p"))
    out = cells.withColumn("x", F.explode(grid)).groupBy("family", "x.final_min", "x.readiness_min", "x.penalty_max").agg(
        F.sum("n").alias("n"),
        F.sum("positives").alias("positives"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(kept, F.col("positives")).otherwise(0)).alias("kept_positive"),
    )
    precision = F.coalesce(F.try_divide(F.col("kept_positive").cast("double"), F.col("kept").cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("kept_positive").cast("double"), F.col("positives").cast("double")), F.lit(0.0))
    leakage = F.coalesce(F.try_divide((F.col("kept") - F.col("kept_positive")).cast("double"), (F.col("n") - F.col("positives")).cast("double")), F.lit(0.0))
    out = out.withColumns({"precision": T.rounded(precision, 4), "recall": T.rounded(recall, 4), "leakage": T.rounded(leakage, 4)})
    return out.withColumn("objective", T.rounded(0.5 * F.col("precision") + 0.3 * F.col("recall") - 0.2 * F.col("leakage"), 4))


def best_scenarios(scenarios: DataFrame, k: int = 8) -> DataFrame:
    order = [F.desc("objective"), F.asc("final_min"), F.asc("readiness_min"), F.asc("penalty_max")]
    return scenarios.withColumn("rank", F.row_number().over(W.partitionBy("family").orderBy(*order))).where(F.col("rank") <= k)


def review_priority(records: DataFrame, k: int) -> DataFrame:
    """The k records whose review tells most."""
    score = (
        0.35 * T.closeness(F.col("final"), 0.5, 0.5)
        + 0.25 * T.closeness(F.col("readiness"), 0.5, 0.5)
        + 0.20 * T.clip(F.col("penalty"))
        + 0.10 * T.clip(F.col("quality"))
        + 0.10 * F.least(F.lit(1.0), F.col("age_days") / 30.0)
    )
    return records.withColumn("priority", T.rounded(score, 4)).orderBy(F.desc("priority"), F.asc("id")).limit(k)


def active_learning(records: DataFrame) -> DataFrame:
    """Uncertainty, salvage, novelty and disagreement of each record, and their blend.

    Novelty is 1 / sqrt of the size of the record's group; sizes come from a grouped count
    that is joined back, so a large group isn't gathered.
    """
    sizes = records.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    out = records.join(sizes, "grp").withColumns(
        {
            "uncertainty": T.rounded(T.closeness(F.col("final"), 0.5, 0.35), 4),
            "salvage": T.rounded(F.when(~F.col("positive"), T.clip(F.col("readiness"))).otherwise(0.0), 4),
            "novelty": T.rounded(1 / F.sqrt("size"), 4),
            "disagreement": T.rounded(F.abs(F.col("final") - F.col("readiness")), 4),
        }
    )
    blend = 0.4 * F.col("uncertainty") + 0.25 * F.col("salvage") + 0.2 * F.col("novelty") + 0.15 * F.col("disagreement")
    return out.withColumn("score", T.rounded(blend, 4))

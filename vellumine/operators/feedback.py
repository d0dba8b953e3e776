"""Outcome rates, pivots, diagnostics, calibration and versions of reviewed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a threshold that are shown.
SAMPLES = 5


def rate(test: Column, of: Column | None = None, places: int = 4) -> Column:
    """Share of rows; null over no rows."""
    whole = F.count(F.lit(1)) if of is None else F.count_if(of)
    part = F.count_if(test if of is None else test & of)
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def outcome_rates(units: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of accepted, revised and discarded units."""
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("accepted")).alias("accept_rate"),
        rate(F.col("revised")).alias("revise_rate"),
        rate(F.col("discarded")).alias("discard_rate"),
        rate(F.col("accepted"), F.col("reviewed")).alias("accept_of_reviewed"),
    )


def outcome(units: DataFrame) -> DataFrame:
    """confirm, modify, discard or other; the first flag wins."""
    return units.withColumn(
        "outcome", F.when(F.col("accepted"), "confirm").when(F.col("revised"), "modify").when(F.col("discarded"), "discard").otherwise("other")
    )


def outcome_pivot(units: DataFrame, states: list[str]) -> DataFrame:
    """Counts of outcomes for every state, those without units too."""
    spine = units.sparkSession.createDataFrame([(s,) for s in states], "state string")
    counts = outcome(units).groupBy("state").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("confirm", "modify", "discard", "other")))
    return F.broadcast(spine).join(counts, "state", "left").na.fill(0)


def penalty_diagnostics(penalties: DataFrame, least: int = 5) -> DataFrame:
    """Per penalty: how often it fired, how such units fared, and a verdict.

    ``penalties``: long (unit, penalty, value, state, accepted, discarded).
    """
    fired = penalties.where("value > 0")
    out = fired.groupBy("penalty").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 4).alias("mean_value"),
        rate(F.col("accepted")).alias("accept_rate"),
        rate(F.col("discarded")).alias("discard_rate"),
        F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"),
    )
    verdict = (
        F.when(F.col("n") < least, "insufficient")
        .when(F.col("accept_rate") >= 0.6, "too_strict")
        .when(F.col("discard_rate") >= 0.5, "effective")
        .otherwise("mixed")
    )
    return out.withColumn("verdict", verdict)


def threshold_diagnostics(failures: DataFrame) -> DataFrame:
    """Per threshold: failures, mean gap, acceptance in spite of it, first five samples.

    Ranks are cut before they are shuffled, so only five samples of each threshold leave a task.
    """
    counted = failures.groupBy("threshold_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("threshold") - F.col("actual")), 4).alias("mean_gap"),
        rate(F.col("accepted")).alias("accepted_anyway"),
    )
    place = F.dense_rank().over(W.partitionBy("threshold_name").orderBy("unit"))
    first = failures.where("unit IS NOT NULL").select("threshold_name", "unit").withColumn("place", place).where(F.col("place") <= SAMPLES).groupBy("threshold_name", "unit").count()
    shown = first.groupBy(F.col("threshold_name").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("unit")), lambda x: x.cast("string")), ",").alias("samples"))
    joined = counted.join(shown, F.col("threshold_name").eqNullSafe(F.col("of")), "left")
    return joined.select("threshold_name", "n", "mean_gap", "accepted_anyway", F.coalesce("samples", F.lit("")).alias("samples"))


def batch_status(items: DataFrame) -> DataFrame:
    """approved, discarded, revising or mixed, by the states of a batch's items."""
    counts = items.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "discarded").alias("discarded"),
        F.count_if(F.col("status") == "revising").alias("revising"),
    )
    status = (
        F.when(F.col("approved") == F.col("n"), "approved")
        .when(F.col("discarded") == F.col("n"), "discarded")
        .when(F.col("revising") > 0, "revising")
        .otherwise("mixed")
    )
    return counts.withColumn("batch_status", status)


def version_diff(versions: DataFrame, fields: list[str]) -> DataFrame:
    """Each version with its parent: a null-safe change flag per field and the list of changes."""
    parent = versions.select(F.col("item").alias("item"), F.col("version").alias("parent_version"), *(F.col(f).alias(f"old_{f}") for f in fields))
    joined = versions.join(parent, ["item", "parent_version"])
    flags = {f"{f}_changed": ~F.col(f).eqNullSafe(F.col(f"old_{f}")) for f in fields}
    names = F.array_compact(F.array(*(F.when(F.col(f"{f}_changed"), f) for f in fields)))
    return joined.withColumns(flags).withColumn("changed", F.array_join(names, ","))


def preference_shift(ranks: DataFrame, weak_state: str = "weak") -> DataFrame:
    """Per group: moves between two rankings, inversions of weak over strong items, verdict.

    ``ranks``: (grp, id, base_rank, new_rank, state).  An inversion is a weak item that stands
    below some strong item at first and above it later; counted against the best strong item
    above it, by running maxima instead of a join of all pairs.
    """

    w = W.partitionBy("grp").orderBy("base_rank", "id").rowsBetween(W.unboundedPreceding, -1)
    worst = F.max(F.when(F.col("state") != weak_state, F.col("new_rank"))).over(w)
    marked = ranks.withColumn("inverted", (F.col("state") == weak_state) & (worst > F.col("new_rank")))
    out = marked.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("base_rank") != F.col("new_rank")).alias("moved"),
        F.max(F.abs(F.col("base_rank") - F.col("new_rank"))).alias("largest_move"),
        F.count_if(F.coalesce("inverted", F.lit(False))).alias("inversions"),
    )
    verdict = (
        F.when(F.col("moved") == 0, "none").when(F.col("inversions") > 0, "unsafe").when(F.col("largest_move") > 3, "borderline").otherwise("safe")
    )
    return out.withColumn("verdict", verdict)


def judge_consensus(votes: DataFrame) -> DataFrame:
    """Per item: unanimous, split, single, insufficient or error."""
    ok = F.col("status") == "ok"
    counts = votes.groupBy("item").agg(
        F.count(F.lit(1)).alias("votes"),
        F.count_if(ok).alias("valid"),
        F.count_distinct(F.when(ok, F.col("decision"))).alias("decisions"),
        F.min(F.when(ok, F.col("decision"))).alias("first_decision"),
    )
    consensus = (
        F.when(F.col("valid") == 0, "error")
        .when(F.col("valid") == 1, F.when(F.col("votes") == 1, "single").otherwise("insufficient"))
        .when(F.col("decisions") == 1, "unanimous")
        .otherwise("split")
    )
    return counts.withColumn("consensus", consensus)

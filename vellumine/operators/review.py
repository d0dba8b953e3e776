"""Linear fits, question checks, funnels, rank stability, policies and review metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .feedback import rate


def fit_scores(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sums of long signals (id, signal, actual) per fit, 1 at most; missing signals count 0."""
    joined = signals.join(F.broadcast(weights), "signal")
    return joined.groupBy("id", "fit").agg(T.rounded(F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("actual"))), 4).alias("score"))


def on_cooldown(last_used: Column, now: Column, days: int) -> Column:
    """Whether less than so many days have gone since the last use."""
    return F.coalesce(T.age_days(last_used, now) < days, F.lit(False))


def number_sequence(text: Column) -> Column:
    """The numbers of a text in order, circled ones too, as an array."""
    circled = "①②③④⑤⑥⑦⑧⑨⑩"
    found = F.regexp_extract_all(text, F.lit(f"[0-9]{{1,6}}|[{circled}]"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]+$"), F.try_to_number(x, F.lit("999999")).cast("int")).otherwise(F.position(x, F.lit(circled))))


def checked(questions: DataFrame) -> DataFrame:
    """errors, warnings, score and verdict of (id, stem, answer, options array<string>)."""
    stem, answer = F.coalesce("stem", F.lit("")), F.coalesce("answer", F.lit(""))
    n = F.size(F.coalesce("options", F.array().cast("array<string>")))
    sizes = F.transform("options", lambda x: F.length(x))
    errors = F.array_compact(
        F.array(
            F.when(stem == "", "empty_stem"),
            F.when(answer == "", "empty_answer"),
            F.when((n < 2) | (n > 6), "option_count"),
            F.when(F.size(F.array_distinct("options")) < n, "repeated_option"),
            F.when((n > 0) & ~F.array_contains("options", answer), "answer_not_an_option"),
        )
    )
    warnings = F.array_compact(
        F.array(F.when(F.array_max(sizes) > 3 * F.array_min(sizes), "unbalanced_options"), F.when(F.length(stem) > 400, "long_stem"))
    )
    out = questions.withColumns({"errors": errors, "warnings": warnings})
    score = F.greatest(F.lit(0), 100 - 25 * F.size("errors") - 5 * F.size("warnings"))
    return out.withColumns({"score": score, "passed": F.size("errors") == 0})


def funnel(articles: DataFrame, materials: DataFrame) -> DataFrame:
    """zero_material, gray_only or stable_present of each article; each side is aggregated first."""
    per = materials.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("channel") == "stable").alias("stable"))
    joined = articles.join(per, "article_id", "left").na.fill(0, ["n", "stable"])
    return joined.withColumn("bucket", F.when(F.col("n") == 0, "zero_material").when(F.col("stable") == 0, "gray_only").otherwise("stable_present"))


def rank_stability(rows: DataFrame, base: list[Column], other: list[Column], k: int) -> DataFrame:
    """Per group: how many of the first k stay among the first k under another order."""
    ranked = rows.withColumns({"a": F.row_number().over(W.partitionBy("grp").orderBy(*base)), "b": F.row_number().over(W.partitionBy("grp").orderBy(*other))})
    top = ranked.where((F.col("a") <= k) | (F.col("b") <= k))
    return top.groupBy("grp").agg(
        F.count_if((F.col("a") <= k) & (F.col("b") <= k)).alias("stay"), F.count_if(F.col("a") == F.col("b")).alias("same_place"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_move")
    )


def review_metrics(actions: DataFrame) -> DataFrame:
    """Two levels: rounds and outcome per item, then means over items by type."""
    items = actions.groupBy("type", "item").agg(F.count(F.lit(1)).alias("rounds"), F.bool_or("approved").alias("approved"), F.count_if("ok").alias("ok"))
    return items.groupBy("type").agg(
        F.count(F.lit(1)).alias("items"),
        rate(F.col("approved")).alias("approval_rate"),
        T.rounded(F.avg("rounds"), 4).alias("mean_rounds"),
        T.rounded(F.sum("ok") / F.sum("rounds"), 4).alias("action_success"),
    )


def profile_signatures(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by the canonical JSON of a profile, keys in order."""
    return rows.groupBy(F.to_json(F.struct(*sorted(columns))).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def policy_space(records: DataFrame, quantiles: list[float]) -> DataFrame:
    """Per family, pairs (final, fallback <= final) of score quantiles."""
    cuts = records.groupBy("family").agg(F.percentile("final", F.array(*map(F.lit, quantiles))).alias("q"))
    one = cuts.select("family", F.explode(F.array_distinct("q")).alias("final_min"), "q")
    both = one.select("family", "final_min", F.explode(F.array_distinct("q")).alias("fallback_min"))
    return both.where(F.col("fallback_min") <= F.col("final_min"))


def evaluate_policies(records: DataFrame, policies: DataFrame) -> DataFrame:
    """Kept and positive records of each policy; policies are few per family and broadcast."""
    joined = records.join(F.broadcast(policies), "family")
    kept = F.col("final") >= F.col("final_min")
    held = ~kept & (F.col("final") >= F.col("fallback_min"))
    out = joined.groupBy("family", "final_min", "fallback_min").agg(
        F.count_if(kept).alias("kept"), F.count_if(kept & F.col("positive")).alias("kept_positive"), F.count_if(held).alias("held"), F.count_if(held & F.col("positive")).alias("held_positive")
    )
    value = F.coalesce(F.try_divide(F.col("kept_positive").cast("double"), F.col("kept").cast("double")), F.lit(0.0))
    rescue = F.coalesce(F.try_divide(F.col("held_positive").cast("double"), F.col("held").cast("double")), F.lit(0.0))
    return out.withColumn("objective", T.rounded(0.8 * value + 0.2 * rescue, 4))


#: Quantiles of a policy axis beside its anchors.
QUANTILES = (0.20, 0.35, 0.50, 0.65, 0.75, 0.85, 0.92)
#: Axis: score, threshold it lies around, distances of the anchors, least and greatest value.
AXES = {
    "final_min": ("final", "recommended", (-0.08, -0.04, 0.0, 0.04, 0.08), 0.15, 0.90),
    "readiness_min": ("readiness", "review_readiness", (-0.10, -0.05, 0.0, 0.05), 0.15, 0.95),
    "penalty_max": ("penalty", "review_penalty", (-0.08, -0.04, 0.0, 0.08, 0.16), 0.0, None),
    "fallback_min": ("final", "fallback_review_score", (-0.10, -0.05, 0.0, 0.05), 0.05, 0.85),
}


def policy_axes(records: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Per family the values of the four axes: anchors around ``thresholds`` and quantiles, as arrays."""
    tail = F.percentile("penalty", F.lit(0.95)).alias("tail")
    cuts = records.groupBy("family").agg(tail)
    greatest = {"penalty_max": F.greatest(F.lit(1.5), F.coalesce(F.col("tail"), F.lit(0.0)) * 1.05)}
    bounds = cuts.select("family", *(greatest.get(a, F.lit(ceil)).cast("double").alias(f"ceil_{a}") for a, (*_, ceil) in AXES.items()))
    clipped = records.join(F.broadcast(bounds), "family")
    values = []
    for axis, (score, name, offsets, floor, _) in AXES.items():
        clip = lambda x, low=floor, high=f"ceil_{axis}": F.greatest(F.lit(low), F.least(F.col(high), x))
        anchors = F.array(*(clip(F.lit(thresholds[name] + d)) for d in offsets))
        q = F.percentile(F.when(F.col(score).isNotNull(), clip(F.col(score))), F.array(*map(F.lit, QUANTILES)))
        every = F.concat(F.first(anchors), F.coalesce(q, F.array().cast("array<double>")))
        values.append(F.array_sort(F.array_distinct(F.transform(every, lambda x: F.round(x, 4)))).alias(axis))
    return clipped.groupBy("family").agg(*values)


def search_policies(records: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Counts and objective of every policy (final, readiness, penalty, fallback) of each family.

    Records (family, final, readiness, penalty, status, stable) are first counted by the cells
    that the thresholds cut, so what meets the policies is bounded by the axes.  Whatever is
    selected also passes the fallback, hence the review queue is what passes it less that.
    """
    axes = policy_axes(records, thresholds)
    floors = F.transform("readiness_min", lambda x: F.greatest(F.lit(0.15), x - 0.08))
    marked = records.join(F.broadcast(axes.withColumn("floors", floors)), "family")

    def above(values: str, score: str) -> Column:
        return F.size(F.filter(values, lambda x: F.coalesce(F.col(score) >= x, F.lit(False))))

    cells = {
        "f": above("final_min", "final"), "r": above("readiness_min", "readiness"), "b": above("fallback_min", "final"), "e": above("floors", "readiness"),
        "p": F.size(F.filter("penalty_max", lambda x: F.coalesce(F.col("penalty") <= x, F.lit(False)))), "o": F.size("penalty_max"),
    }
    gone = F.coalesce(F.col("status") == "deprecated", F.lit(False))
    kinds = {
        "n": F.lit(True), "stable": ~gone & (F.coalesce(F.col("status") == "promoted", F.lit(False)) | F.coalesce("stable", F.lit(False))),
        "gray": F.col("status") == "gray", "deprecated": gone,
    }
    counted = marked.select("family", *(c.alias(k) for k, c in cells.items()), *(x.alias(f"k_{k}") for k, x in kinds.items()))
    counted = counted.groupBy("family", *cells).agg(*(F.count_if(f"k_{k}").alias(k) for k in kinds))
    total = counted.groupBy("family").agg(F.sum("n").alias("total"))
    three = axes.select("family", F.posexplode("final_min").alias("i", "final_min"), "readiness_min", "penalty_max")
    three = three.select("family", "i", "final_min", F.posexplode("readiness_min").alias("j", "readiness_min"), "penalty_max")
    three = three.select("family", "i", "final_min", "j", "readiness_min", F.posexplode("penalty_max").alias("m", "penalty_max"))
    two = axes.select("family", F.posexplode("fallback_min").alias("l", "fallback_min"), "readiness_min")
    two = two.select("family", "l", "fallback_min", F.posexplode("readiness_min").alias("j", "readiness_min")).drop("readiness_min")
    zero = F.lit(0).cast("bigint")
    # a penalty within the m-th bound is within all later ones
    within = (F.col("f") > F.col("i")) & (F.col("r") > F.col("j")) & (F.col("p") >= F.col("o") - F.col("m"))
    picked = three.join(counted, "family").groupBy("family", "i", "final_min", "j", "readiness_min", "m", "penalty_max")
    picked = picked.agg(*(F.sum(F.when(within, F.col(k)).otherwise(zero)).alias(f"selected_{k}") for k in kinds))
    passing = (F.col("b") > F.col("l")) & (F.col("e") > F.col("j"))
    held = two.join(counted, "family").groupBy("family", "l", "fallback_min", "j").agg(*(F.sum(F.when(passing, F.col(k)).otherwise(zero)).alias(f"passing_{k}") for k in kinds))
    out = picked.join(held, ["family", "j"]).where("fallback_min <= final_min").join(total, "family")
    out = out.withColumns({f"review_{k}": F.col(f"passing_{k}") - F.col(f"selected_{k}") for k in kinds})

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    objective = (
        share("selected_stable", "selected_n") - 1.75 * share("selected_deprecated", "selected_n") - 0.30 * share("selected_gray", "selected_n")
        + F.least(F.lit(0.12), share("selected_n", "total") * 0.24) + F.least(F.lit(0.06), share("review_gray", "review_n") * 0.06)
        - 0.16 * share("review_deprecated", "review_n") + F.least(F.lit(0.03), share("review_n", "total") * 0.03)
    )
    counts = [f"selected_{k}" for k in kinds] + ["review_n", "review_gray", "review_deprecated"]
    return out.select("family", *AXES, *counts, F.round(objective, 4).alias("objective"))


def selection_state(final: Column, readiness: Column, penalty: Column) -> Column:
    """recommended, hold or weak."""
    return F.when((final >= 0.6) & (readiness >= 0.5) & (penalty <= 0.4), "recommended").when((final >= 0.45) & (penalty <= 0.7), "hold").otherwise("weak")


def difficulty_band(vector: Column) -> Column:
    """easy, medium or hard by how many of the entries are high or low."""
    high = F.size(F.filter(vector, lambda x: x >= 0.66))
    low = F.size(F.filter(vector, lambda x: x <= 0.33))
    return F.when(high >= 2, "hard").when(low >= 2, "easy").otherwise("medium")

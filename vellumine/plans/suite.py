"""The offline suite: backtest, threshold search and review queue over one table of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, reports, review, search

#: Measures of the backtest, over records (id, article_id, family, task, final, readiness, penalty, quality, positive, age_days, status, stable).
COUNTS = {"n": "count(*)", "n_articles": "count(DISTINCT article_id)", "n_positive": "count_if(positive)", "n_gray": "count_if(status = 'gray')", "n_promoted": "count_if(status = 'promoted')", "n_deprecated": "count_if(status = 'deprecated')"}
MEANS = {"avg_final": "final", "avg_readiness": "readiness", "avg_penalty": "penalty"}
TAILS = {"p75_final": "final", "p75_readiness": "readiness"}


def run_suite(records: DataFrame, current: dict[str, float], finals: Sequence[float], readiness: Sequence[float], penalties: Sequence[float], queue: int = 100) -> dict[str, DataFrame]:
    """The three reports by name: measures of families and tasks, the best policies with a verdict, and the review queue."""
    grid = evaluate.best_scenarios(evaluate.threshold_grid(records, list(finals), list(readiness), list(penalties)))
    policies = review.search_policies(records, current)
    rate = F.lit(1.0) - F.col("precision")
    return {
        "backtest": reports.measures(records, ["family", "task"], COUNTS, MEANS, TAILS, 0.75),
        "thresholds": grid.withColumn("verdict", search.apply_verdict(F.col("objective"), F.col("kept"), rate)),
        "policies": policies,
        "queue": evaluate.review_priority(records, queue),
    }


def write_suite(suite: dict[str, DataFrame], folder: str) -> None:
    """Each report as JSON lines in a folder of its own."""
    for name, report in suite.items():
        report.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")

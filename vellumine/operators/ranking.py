"""Ranking of candidates within a family, and the guardrail for slots at the edge of a text.

A family's sort key is a row of expressions, so that one table of candidates of all families is
ranked by one window over (query, k1, k2, …).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rules
from .rules import Layer, number

KEYS = tuple(f"k{i}" for i in range(1, 9))
SIGNALS = (
    "selection family_match structure center axis_score argument_score task_final quality card_score business_score closure_score titleability reference_dependency bidirectional_validation "
    "backward_link_strength forward_link_strength sequence_integrity multi_path_risk opening_signal_strength closing_signal_strength"
).split()
_EDGE = "blank_position IN ('opening', 'inserted') AND NOT covered"
_ABOVE = lambda x, least: f"greatest(0e0, {x} - {number(least)})"
#: What adds to the first key of a slot to fill. Reads blank_position, covered, function_type, structure_kind (leading, loose or other), width.
FILL: list[Layer] = [
    {"cohesion": rules.rounded("(bidirectional_validation + backward_link_strength + forward_link_strength) / 3e0")},
    {
        "edge_penalty": rules.first(
            [
                (f"NOT ({_EDGE})", "0e0"),
                ("selection >= 0.92", "0.03e0"),
            ],
            "0.1e0 + CASE WHEN selection < 0.88 THEN 0.03e0 ELSE 0e0 END + least(0.09e0, greatest(0, width - 2) * 0.03e0) + least(0.03e0, reference_dependency * 0.03e0)",
        ),
        "middle_bonus": f"CASE WHEN blank_position = 'middle' THEN 0.08e0 + 0.1e0 * {_ABOVE('cohesion', 0.70)} ELSE 0e0 END",
        "closure_bonus": rules.first(
            [
                ("blank_position = 'middle'", f"0.02e0 + 0.04e0 * {_ABOVE('closure_score', 0.55)} + 0.03e0 * {_ABOVE('cohesion', 0.68)}"),
                ("blank_position IN ('opening', 'inserted')", f"0.02e0 * {_ABOVE('closure_score', 0.60)}"),
            ],
            f"0.01e0 * {_ABOVE('closure_score', 0.60)}",
        ),
        "clarity_bonus": rules.weighted(
            {_ABOVE("titleability", 0.62): 0.03, _ABOVE("closure_score", 0.60): 0.02},
            {
                "blank_position = 'opening' AND function_type IN ('topic_intro', 'summary') AND structure_kind = 'leading'": 0.03,
                "blank_position = 'opening' AND function_type IN ('topic_intro', 'summary') AND structure_kind = 'loose'": -0.01,
                "blank_position = 'inserted' AND function_type = 'reference_summary'": 0.02,
            },
        ),
        "relief_bonus": f"CASE WHEN {_EDGE} AND selection >= 0.92 AND family_match >= 0.88 THEN 0.05e0 ELSE 0e0 END",
        "discourse_bonus": "CASE WHEN NOT covered AND blank_position = 'opening' AND function_type IN ('topic_intro', 'summary') AND structure_kind = 'leading' THEN 0.035e0 ELSE 0e0 END",
    },
    {
        "fill_first": "selection - edge_penalty + middle_bonus + closure_bonus + clarity_bonus + relief_bonus + 0.14e0 * cohesion + discourse_bonus",
        "compact_fit": rules.rounded(
            rules.weighted(
                {"cohesion": 0.14, "closure_score": 0.10},
                {"candidate_type IN ('closed_span', 'functional_slot_unit')": 0.18, "width BETWEEN 1 AND 2": 0.08, "blank_position = 'middle'": 0.06, _EDGE: -0.06},
            )
        ),
    },
]
# The sort key of each family, in order.
FAMILY_KEYS = {
    "sentence_fill": ("fill_first", "family_match + 0.26e0 * cohesion + clarity_bonus", "structure", "task_final", "quality", "round(card_score, 4)", "round(business_score, 4)"),
    "center_understanding": (
        "selection - CASE WHEN anchor_role = 'review_holdout_boundary' THEN 0.12e0 ELSE 0e0 END", "center", rules.rounded("(axis_score + argument_score) / 2e0"), "family_match", "structure", "task_final", "quality", "card_score",
    ),
    "sentence_order": (
        "selection + CASE WHEN candidate_type = 'sentence_block_group' THEN 0.1e0 ELSE 0e0 END", rules.rounded("(opening_signal_strength + closing_signal_strength + sequence_integrity + 1 - multi_path_risk) / 4e0"),
        rules.rounded("(sequence_integrity + 1 - multi_path_risk) / 2e0"), "family_match", "task_final", "quality", "card_score", "business_score",
    ),
}
OTHER_KEYS = ("selection", "family_match", "structure", "task_final", "quality", "card_score", "business_score")
#: Keys to nine places, so that sums in another order compare alike.
SORT: list[Layer] = [
    *FILL,
    {
        k: f"round({rules.by_value('family', {f: (own[i] if i < len(own) else '0e0') for f, own in FAMILY_KEYS.items()}, OTHER_KEYS[i] if i < len(OTHER_KEYS) else '0e0')} + 1e-12, 9)"
        for i, k in enumerate(KEYS)
    },
]


def ranked(candidates: DataFrame, by: str, k: int) -> DataFrame:
    """The k best candidates of each (by, family); ties by id."""
    rows = rules.apply(candidates, SORT)
    place = F.row_number().over(W.partitionBy(by, "family").orderBy(*(F.desc(x) for x in KEYS), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def should_swap(high: Column, low: Column) -> Column:
    """Whether a compact slot may pass the wide one before it, whose blank stands at an uncovered edge.

    Both: structs of candidate_type, edge_risk, selection, width, k1 to k7, quality, card_score, business_score and fit.
    """
    gap = lambda i: high[f"k{i}"] - low[f"k{i}"]
    better = (low["quality"] < high["quality"]) | (low["card_score"] < high["card_score"]) | (low["business_score"] < high["business_score"])
    prefix = lambda x: F.struct(*(x[f"k{i}"] for i in range(1, 5)))
    tied = (
        (prefix(low) >= prefix(high))
        | ((gap(1) <= 0.03) & (gap(2) <= 0.015) & better)
        | ((gap(1) <= 0.03) & (low["fit"] >= high["fit"] + 0.18) & better)
        | ((gap(1) <= 0.012) & (gap(2) <= -0.03) & (low["fit"] >= high["fit"] + 0.12) & (high["width"] >= low["width"]))
    )
    whole = lambda x: F.struct(*(x[f"k{i}"] for i in range(1, 8)))
    return (
        high["candidate_type"].isin("multi_paragraph_unit", "whole_passage") & low["candidate_type"].isin("closed_span", "functional_slot_unit") & (whole(high) > whole(low))
        & (high["selection"] - low["selection"] <= 0.045) & (high["width"] > 0) & (low["width"] > 0) & high["edge_risk"] & (low["fit"] >= high["fit"] + 0.03) & tied
    )


def guarded(best: DataFrame, by: str) -> DataFrame:
    """``ranked`` slots to fill with ``place`` after one pass over neighbours, from the first to the last.

    The candidates of a query are few (k of ``ranked``) and stand in one array.
    """
    fields = ["id", "candidate_type", F.expr(_EDGE).alias("edge_risk"), "selection", "width", *KEYS[:7], "quality", "card_score", "business_score", F.col("compact_fit").alias("fit")]
    lists = best.where("family = 'sentence_fill'").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("items"))
    none = F.slice("items", 1, 0)
    state = lambda done, held: F.struct(done.alias("done"), held.alias("held"))
    swept = F.aggregate(
        F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), state(none, F.col("items")[0]),
        lambda acc, x: F.when(F.coalesce(should_swap(acc["held"], x), F.lit(False)), state(F.array_append(acc["done"], x), acc["held"])).otherwise(state(F.array_append(acc["done"], acc["held"]), x)),
        lambda acc: F.array_append(acc["done"], acc["held"]),
    )
    return lists.select(by, F.posexplode(swept).alias("i", "x")).select(by, "x.id", (F.col("i") + 1).alias("place"), F.col("x.place").alias("place_before"))

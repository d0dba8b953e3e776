"""Validation of ordering questions against a contract.

A check is a row: its name, when it fails, and the error that it stands for.  Limits are columns
of the contract; a limit that is null asks for nothing.  Errors are an ordered distinct list.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAIN, COUNT = "ordering_chain_incomplete", "sentence_count_mismatch"
#: Score and penalty columns with the contract's limit for each: a least or a greatest value, and what a score may miss it by.
LEAST = {
    "unique_opener_score": ("unique_opener_min_score", CHAIN, 0.0), "binding_pair_count": ("expected_binding_pair_count", CHAIN, 0.0), "unique_answer_strength": ("expected_unique_answer_strength", CHAIN, 0.06),
    "final_score": ("min_final_candidate_score", "final_candidate_score_below_floor", 0.0), "readiness_score": ("min_readiness_score", "readiness_score_below_floor", 0.0),
    "complexity": ("min_complexity_score", "complexity_below_floor", 0.0), "constraint_intensity": ("min_constraint_intensity_score", "constraint_intensity_below_floor", 0.0),
}
MOST = {
    "exchange_risk": ("exchange_risk_max", CHAIN), "multi_path_risk": ("multi_path_risk_max", CHAIN), "function_overlap": ("function_overlap_max", CHAIN), "total_penalty": ("max_total_penalty", "total_penalty_above_ceiling"),
    "first_instability": ("max_first_instability_penalty", "first_instability_above_ceiling"), "last_instability": ("max_last_instability_penalty", "last_instability_above_ceiling"),
    "weak_constraint": ("max_weak_constraint_penalty", "weak_constraint_above_ceiling"),
}


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def order_checks(q: DataFrame, limits: Mapping[str, object]) -> DataFrame:
    """``q`` with failed (names of checks), errors and warnings.

    Columns: n_material_units, options (map<string, array<int>>: the order that each option gives), correct_order (array<int>),
    answer, analysis_orders (array<array<int>>), unit_sentences (array<int>), roles (array<string>, in the correct order), bindings
    (array<struct<a, b>>: a must stand before b), head_illegal, tail_illegal, has_closing, context_closure, order_style, and the
    columns of ``LEAST`` and ``MOST``.  limits: those of the contract, and whether it asks for head, tail, bindings and roles.
    """
    c = F.col
    limit = lambda name: F.lit(limits.get(name)).cast("double")
    wants = lambda name: F.lit(bool(limits.get(name)))
    n_units, expected = F.size("unit_sentences"), limit("sortable_unit_count").cast("int")
    sizes = F.array_distinct(F.transform(F.map_values("options"), lambda o: F.size(o)))
    right = F.filter(F.map_values("options"), lambda o: _same(o, c("correct_order")))
    size = F.coalesce(expected, n_units)
    whole = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    place = lambda x: F.array_position("correct_order", x)
    broken = F.exists("bindings", lambda b: (place(b["a"]) > 0) & (place(b["b"]) > 0) & (place(b["a"]) > place(b["b"])))
    last = F.size("roles")
    conflict = F.exists(F.slice("roles", 1, F.greatest(last - 1, F.lit(0))), lambda r: r == "conclusion") | _same(F.element_at("roles", -1), F.lit("thesis"))
    conflict = conflict | (_same(F.get("roles", F.lit(0)), F.lit("transition")) & ~(wants("require_legal_head") & c("head_illegal")))
    checks: list[tuple[str, Column, str]] = [
        ("material_units", c("n_material_units") < 4, CHAIN),
        ("option_sizes", F.size(sizes) > 1, CHAIN),
        ("unit_count", F.when(expected.isNotNull(), n_units != expected).otherwise(n_units < 2), COUNT),
        ("unit_sentences", F.exists("unit_sentences", lambda n: (n < 1) | (n > 2)), CHAIN),
        ("correct_order", (F.size("correct_order") < 1) | ((size > 0) & ~_same(F.array_sort("correct_order"), whole)), CHAIN),
        ("single_truth", F.size(right) != 1, CHAIN),
        ("answer", ~_same(F.try_element_at("options", F.upper(F.trim("answer"))), c("correct_order")), CHAIN),
        ("analysis", F.coalesce(F.size("analysis_orders") < 1, F.lit(True)) | F.exists("analysis_orders", lambda o: ~_same(o, c("correct_order"))), CHAIN),
        ("unit_alignment", expected.isNotNull() & (F.array_max(sizes) != expected) & (c("n_material_units") != expected), COUNT),
        ("closure", limit("closure_min_score").isNotNull() & (~c("has_closing") | (c("context_closure") < limit("closure_min_score"))), CHAIN),
        *((score, c(score) + slack < limit(name), error) for score, (name, error, slack) in LEAST.items()),
        *((score, c(score) > limit(name), error) for score, (name, error) in MOST.items()),
        ("head", wants("require_legal_head") & c("head_illegal"), "illegal_head"),
        ("tail", wants("require_legal_tail") & c("tail_illegal"), "illegal_tail"),
        ("bindings", wants("require_binding_pairs_intact") & broken, "binding_violation"),
        ("roles", wants("require_complete_ordering_chain") & (last > 0) & conflict, "role_order_conflict"),
    ]
    fails = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("check"), F.lit(error).alias("error"))) for name, test, error in checks)))
    out = q.withColumn("__x_fails", fails)
    risky = (c("readiness_score") >= F.coalesce(limit("min_readiness_score"), F.lit(0.5))) & (c("total_penalty") >= F.coalesce(limit("max_total_penalty"), F.lit(0.55)))
    warnings = F.array_compact(F.array(F.when(~c("order_style"), "stem_is_no_ordering_prompt"), F.when(wants("review_if_high_readiness_high_penalty") & risky, "high_readiness_high_penalty")))
    out = out.withColumns({"failed": F.transform("__x_fails", lambda x: x["check"]), "errors": F.array_distinct(F.transform("__x_fails", lambda x: x["error"])), "warnings": warnings})
    return out.drop("__x_fails")

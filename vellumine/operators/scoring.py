"""Task scores, plan scores, candidate quality, readiness, selection and bridge scores.

Each rule set is a list of layers for ``rules.apply``.  Its signals are columns of numbers in
[0, 1] (``SIGNALS`` names all that a set reads), its other inputs columns named in its comment.
The weights and thresholds are fixed values.
"""

from __future__ import annotations

from .rules import Layer, by_value, first, mean, number, ranked, reason, rounded, score, unit, weighted

MAIN_TYPES = ("whole_passage", "closed_span", "multi_paragraph_unit")
ORDER_TYPES = ("ordered_unit_group", "weak_formal_order_group")
CANDIDATE_TYPES = (*MAIN_TYPES, "functional_slot_unit", *ORDER_TYPES, "sentence_block_group", "insertion_context_unit")
UNITS = 6


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# Eligibility of main ideas: candidate_type, n_paragraphs, n_sentences -------------------

MAIN_SIGNALS = (
    "single_center_strength object_scope_stability core_object_anchor_strength branch_focus_strength multi_dimension_cohesion titleability closure_score "
    "summary_strength analysis_to_conclusion_strength context_dependency theme_raise_strength value_judgement_strength example_to_theme_strength "
    "non_key_detail_density case_macro_shift_strength problem_signal_strength countermeasure_signal_strength"
).split()
# Weights by score and signal.
MAIN_WEIGHTS = {
    "center": {"single_center_strength": 0.38, "object_scope_stability": 0.24, "core_object_anchor_strength": 0.18, "titleability": 0.10, "multi_dimension_cohesion": 0.10, "branch_focus_strength": -0.18},
    "closure": {"closure_score": 0.54, "summary_strength": 0.18, "analysis_to_conclusion_strength": 0.16, "(1 - context_dependency)": 0.08, "value_judgement_strength": 0.04},
    "lift": {
        "titleability": 0.34, "summary_strength": 0.18, "analysis_to_conclusion_strength": 0.18, "theme_raise_strength": 0.12, "value_judgement_strength": 0.10,
        "core_object_anchor_strength": 0.08, "problem_signal_strength": 0.06, "countermeasure_signal_strength": 0.04, "non_key_detail_density": -0.18,
    },
    "example": {
        "non_key_detail_density": 0.42, "greatest(0e0, 0.58e0 - example_to_theme_strength)": 0.18, "case_macro_shift_strength": 0.16, "branch_focus_strength": 0.14,
        "greatest(0e0, 0.56e0 - titleability)": 0.10,
    },
}
SUPPORTED = one_of("candidate_type", MAIN_TYPES)
ELIGIBILITY: list[Layer] = [
    {f"raw_{k}": unit(weighted(w)) for k, w in MAIN_WEIGHTS.items()},
    {
        "center_ok": "raw_center >= 0.46 AND single_center_strength >= 0.48 AND object_scope_stability >= 0.50 AND NOT (branch_focus_strength >= 0.62 AND multi_dimension_cohesion < 0.56)",
        "closure_ok": "raw_closure >= 0.50 AND closure_score >= 0.46 AND NOT (n_paragraphs >= 4 AND n_sentences >= 8 AND closure_score < 0.50 AND summary_strength < 0.42)",
        "lift_ok": "raw_lift >= 0.50 AND greatest(titleability, summary_strength, analysis_to_conclusion_strength, theme_raise_strength) >= 0.42",
        "example_ok": "raw_example <= 0.52 AND NOT (non_key_detail_density >= 0.62 AND example_to_theme_strength < 0.54)",
    },
    {
        "eligibility": reason(
            [(f"NOT ({SUPPORTED})", "unsupported_unit_type"), ("NOT center_ok", "single_center_weak"), ("NOT closure_ok", "closure_weak"), ("NOT lift_ok", "theme_not_liftable"), ("NOT example_ok", "example_dominant")],
            "main_idea_eligible",
        ),
        "mi_center": f"CASE WHEN {SUPPORTED} THEN {rounded('raw_center')} ELSE 0e0 END",
        "mi_closure": f"CASE WHEN {SUPPORTED} THEN {rounded('raw_closure')} ELSE 0e0 END",
        "mi_lift": f"CASE WHEN {SUPPORTED} THEN {rounded('raw_lift')} ELSE 0e0 END",
        "mi_example": f"CASE WHEN {SUPPORTED} THEN {rounded('raw_example')} ELSE 1e0 END",
    },
]

# Task scores ----------------------------------------------------------------------------

# Thresholds by task.
THRESHOLDS = {
    "main_idea": {"recommended": 0.50, "readiness": 0.60, "penalty": 0.28, "fallback": 0.40, "least": 0.52},
    "fill": {"recommended": 0.54, "readiness": 0.58, "penalty": 0.28, "fallback": 0.42, "least": 0.50},
    "order": {"recommended": 0.56, "readiness": 0.58, "penalty": 0.24, "fallback": 0.46, "least": 0.50},
}
DIMENSIONS = ("complexity", "ambiguity", "depth", "constraint")


def task(name: str, readiness: dict[str, float], penalties: dict[str, float], difficulty: dict[str, dict[str, float]], may: str, also: str = "false") -> list[Layer]:
    """Readiness, final score, recommendation, review and difficulty of a task.

    penalties: what each penalty takes off; may: which candidates can be recommended; also:
    which others need a review.
    """
    t, p = THRESHOLDS[name], lambda x: f"{name}_{x}"
    hard = " + ".join(f"CASE WHEN {p(d)} >= 0.67 THEN 1 ELSE 0 END" for d in DIMENSIONS)
    some = " + ".join(f"CASE WHEN {p(d)} >= 0.45 THEN 1 ELSE 0 END" for d in DIMENSIONS)
    core = " + ".join(f"CASE WHEN {p(d)} >= 0.62 THEN 1 ELSE 0 END" for d in ("ambiguity", "depth", "constraint"))
    risky = f"{p('readiness')} >= {t['readiness']} AND {p('penalty')} >= {t['penalty']}"
    near = f"NOT {p('recommended')} AND {p('readiness')} >= {number(max(t['least'], t['readiness'] - 0.08))} AND {p('final')} >= {t['fallback']}"
    return [
        {p("readiness"): score(readiness), p("penalty"): score(dict.fromkeys(penalties, 1.0)), **{p(d): score(w) for d, w in difficulty.items()}},
        {p("final"): score({p("readiness"): 1.0, **{k: -v for k, v in penalties.items()}}), p("difficulty"): mean(*(p(d) for d in DIMENSIONS))},
        {p("recommended"): f"({may}) AND {p('final')} >= {t['recommended']}"},
        {
            p("needs_review"): f"({risky}) OR ({near}) OR ({also})",
            p("band"): reason(
                [(f"({hard}) >= 2 AND ({core}) >= 2 OR {p('difficulty')} >= 0.68", "hard"), (f"{p('difficulty')} <= 0.38 AND ({some}) <= 1 AND {p('ambiguity')} < 0.55", "easy")], "medium"
            ),
        },
        {
            p("note"): reason(
                [
                    (f"{p('penalty')} >= 0.55 AND {p('difficulty')} < 0.62", "high_risk_but_not_high_difficulty"),
                    (f"{p('band')} = 'hard' AND {p('final')} < 0.35", "hard_but_currently_weak_candidate"),
                    (f"{p('band')} = 'hard'", "structurally_hard_candidate"),
                    (f"{p('final')} < 0.35 AND {p('difficulty')} < 0.45", "not_hard_but_currently_weak_candidate"),
                ],
                "difficulty_and_quality_balanced",
            )
        },
    ]


#: Reads the results of ELIGIBILITY.
MAIN_TASK = task(
    "main_idea",
    {"mi_center": 0.40, "mi_closure": 0.30, "mi_lift": 0.30},
    {"mi_example": 0.35},
    {
        "complexity": {"mi_closure": 0.38, "mi_lift": 0.37, "multi_dimension_cohesion": 0.25},
        "ambiguity": {"mi_example": 0.45, "(1 - mi_center)": 0.35, "branch_focus_strength": 0.20},
        "depth": {"mi_lift": 0.45, "mi_closure": 0.35, "mi_center": 0.20},
        "constraint": {"mi_center": 0.36, "mi_closure": 0.32, "mi_lift": 0.32},
    },
    "eligibility = 'main_idea_eligible'",
)
# main_idea penalties weigh 1 in the total
FILL_SIGNALS = "carry_dependency bridge_dependency forward_dependency summary_strength countermeasure_signal_strength object_match_strength standalone_readability".split()
FUNCTIONS = ("carry_previous", "bridge", "lead_next", "topic_intro", "summary", "conclusion", "countermeasure")
# How hard a function of a slot is.
FUNCTION_COMPLEXITY = {"carry_previous": 0.48, "bridge": 0.76, "lead_next": 0.54, "topic_intro": 0.42, "summary": 0.36, "conclusion": 0.40, "countermeasure": 0.58}
_DEPENDENCIES = ("carry_dependency", "bridge_dependency", "forward_dependency")
#: Reads candidate_type, function_type, blank_value_ready, slot_explicit_ready, n_sentences, n_chars, context_sentences.
FILL_TASK: list[Layer] = [
    {
        "slot_dependency": by_value(
            "function_type",
            {
                "carry_previous": "carry_dependency", "bridge": "bridge_dependency", "lead_next": "forward_dependency",
                "topic_intro": score({"object_match_strength": 0.55, "forward_dependency": 0.45}), "summary": "summary_strength", "conclusion": "summary_strength",
                "countermeasure": "countermeasure_signal_strength",
            },
            f"greatest({', '.join(_DEPENDENCIES)})",
        ),
        "top_dependency": f"greatest({', '.join(_DEPENDENCIES)})",
        "second_dependency": "greatest(least(carry_dependency, bridge_dependency), least(carry_dependency, forward_dependency), least(bridge_dependency, forward_dependency))",
        "function_complexity": by_value("function_type", FUNCTION_COMPLEXITY, 0.45),
        "context_span": score({"context_sentences": 0.25}),
    },
    {
        "blank_value": "CASE WHEN blank_value_ready THEN " + rounded(unit("greatest(0.58e0, slot_dependency, CASE WHEN function_type = 'topic_intro' THEN 0.5e0 * object_match_strength + 0.5e0 * forward_dependency ELSE 0e0 END)")) + " ELSE 0e0 END",
        "role_ambiguity": "CASE WHEN top_dependency > 0 THEN " + rounded(unit("greatest(0e0, 0.28e0 - (top_dependency - second_dependency)) / 0.28e0")) + " ELSE 0.4e0 END",
        "standalone": rounded(unit("greatest(0e0, standalone_readability - 0.62e0) / 0.38e0")),
        "overlong": rounded(unit("0.55e0 * greatest(0, n_sentences - 1) + 0.45e0 * greatest(0, n_chars - 48) / 52e0")),
    },
    {"role_confidence": score({"top_dependency": 1.0, "role_ambiguity": -0.40}, {"slot_explicit_ready": 0.12}), "slot_dependency_score": rounded(unit("slot_dependency"))},
    *task(
        "fill",
        {"blank_value": 0.50, "slot_dependency": 0.30, "role_confidence": 0.20},
        {"standalone": 0.25, "role_ambiguity": 0.15, "overlong": 0.10},
        {
            "complexity": {"slot_dependency_score": 0.45, "blank_value": 0.25, "context_span": 0.15, "function_complexity": 0.15},
            "ambiguity": {"role_ambiguity": 0.45, "standalone": 0.25, "(1 - role_confidence)": 0.30},
            "depth": {"slot_dependency_score": 0.55, "blank_value": 0.35, "function_complexity": 0.10},
            "constraint": {"blank_value": 0.40, "slot_dependency_score": 0.35, "role_confidence": 0.25},
        },
        "candidate_type = 'functional_slot_unit' AND slot_explicit_ready AND blank_value_ready",
    ),
]
ORDER_SIGNALS = "unique_opener_score closing_signal_strength sequence_integrity local_binding_strength".split()


def _stability(held: str, many: str) -> str:
    return first([(f"{held} AND {many} = 1", "1e0"), (f"{held} AND {many} <= 2", "0.78e0"), (held, "0.56e0")], "0e0")


#: Reads candidate_type, first_held, n_first, last_held, n_last (whether the first or last unit is among the candidates for its
#: place, and how many there are), n_precedence, n_bindings, n_grouped, n_units.
ORDER_TASK: list[Layer] = [
    {"first_stability": _stability("first_held", "n_first"), "last_stability": _stability("last_held", "n_last")},
    {
        "first_fit": score({"first_stability": 0.55, "unique_opener_score": 0.45}),
        "last_fit": score({"last_stability": 0.55, "closing_signal_strength": 0.45}),
        "pairwise": score({"n_precedence": 0.22, "n_bindings": 0.12, "sequence_integrity": 0.32}),
        "binding": score({"n_bindings": 0.28, "local_binding_strength": 0.40}),
        "first_instability": rounded("1e0 - first_stability"),
        "last_instability": rounded("1e0 - last_stability"),
        "over_merge": rounded(unit("n_grouped / 3e0")),
        "unit_share": rounded(unit(f"n_units / {number(UNITS)}")),
        "grouped_complexity": rounded(unit("n_grouped / 2e0")),
    },
    {"weak_constraint": rounded(unit("greatest(0e0, 0.55e0 - pairwise) / 0.55e0"))},
    *task(
        "order",
        {"first_fit": 0.25, "last_fit": 0.25, "pairwise": 0.30, "binding": 0.20},
        {"first_instability": 0.25, "last_instability": 0.30, "weak_constraint": 0.20, "over_merge": 0.10},
        {
            "complexity": {"pairwise": 0.40, "binding": 0.25, "unit_share": 0.20, "grouped_complexity": 0.15},
            "ambiguity": {"first_instability": 0.35, "last_instability": 0.35, "weak_constraint": 0.30},
            "depth": {"pairwise": 0.40, "binding": 0.30, "first_fit": 0.15, "last_fit": 0.15},
            "constraint": {"pairwise": 0.45, "binding": 0.30, "first_fit": 0.15, "last_fit": 0.10, "weak_constraint": -0.20},
        },
        f"candidate_type = 'ordered_unit_group' AND n_units = {UNITS}",
        f"candidate_type = 'weak_formal_order_group' AND n_units = {UNITS} AND order_readiness >= 0.48 AND order_final >= 0.32",
    ),
]

# Plan scores: candidate_type, n_paragraphs (of the article), covered, composition, blank_position, function_type, flags ------

PLAN_SIGNALS = (
    "context_dependency closure_score single_center_strength summary_strength titleability structure_completeness meaningfulness sequence_integrity unique_opener_score "
    "exchange_risk multi_path_risk progression_strength bidirectional_validation backward_link_strength forward_link_strength countermeasure_signal_strength "
    "local_binding_strength opening_signal_strength closing_signal_strength block_order_complexity context_closure_score planner_priority"
).split()
# Weights and bonuses by kind of candidate.
PLAN_BASE = ({"(1 - context_dependency)": 0.34, "closure_score": 0.24, "single_center_strength": 0.22, "summary_strength": 0.10}, {})
PLAN_WHOLE = ({**PLAN_BASE[0], "titleability": 0.08}, {"repeated_openings": -0.16, "heading_like": -0.10, "directive_like": -0.08})
PLAN_BLOCKS = (
    {
        "structure_completeness": 0.24, "meaningfulness": 0.22, "sequence_integrity": 0.12, "(1 - context_dependency)": 0.10, "closure_score": 0.10, "unique_opener_score": 0.10,
        "least(1e0, n_bindings / 3e0)": 0.06, "progression_strength": 0.06, "exchange_risk": -0.10, "multi_path_risk": -0.08,
    },
    {"dependent_opening": -0.18, f"n_units <> {UNITS}": -0.40, f"n_units = {UNITS}": 0.08},
)
PLAN_INSERTION = ({"bidirectional_validation": 0.30, "backward_link_strength": 0.24, "forward_link_strength": 0.24, "(1 - context_dependency)": 0.12}, {})
PLAN_SLOT = (
    {
        "closure_score": 0.18, "single_center_strength": 0.16, "(1 - context_dependency)": 0.12, "greatest(bidirectional_validation, backward_link_strength, forward_link_strength)": 0.12,
        "summary_strength": 0.12, "countermeasure_signal_strength": 0.12,
    },
    {"slot_explicit_ready": 0.18, "blank_position IN ('opening', 'ending')": 0.05, "function_type = 'bridge'": 0.04},
)
PLAN_ORDER = (
    {
        "sequence_integrity": 0.24, "local_binding_strength": 0.18, "opening_signal_strength": 0.14, "closing_signal_strength": 0.14, "block_order_complexity": 0.12,
        "context_closure_score": 0.10, "(1 - exchange_risk)": 0.08,
    },
    {"candidate_type = 'weak_formal_order_group'": -0.04},
)
# Bonus of the scope that a candidate covers, else its malus.
SCOPE = {
    "whole_passage": ("n_paragraphs <= 6", 0.04, -0.08),
    "multi_paragraph_unit": ("covered BETWEEN 2 AND 3", 0.06, -0.04),
    "closed_span": ("covered <= 2", 0.05, -0.04),
    "functional_slot_unit": ("covered <= 2", 0.08, -0.06),
    "ordered_unit_group": ("covered <= 3", 0.08, -0.06),
    "weak_formal_order_group": ("covered <= 3", 0.08, -0.06),
}
# Least plan score and number of candidates by type.
PLAN_LEAST = {
    "whole_passage": 0.48, "closed_span": 0.44, "multi_paragraph_unit": 0.48, "functional_slot_unit": 0.50, "ordered_unit_group": 0.56, "weak_formal_order_group": 0.52,
    "sentence_block_group": 0.52, "insertion_context_unit": 0.46,
}
PLAN_LIMITS = {
    "whole_passage": 1, "closed_span": 6, "multi_paragraph_unit": 6, "functional_slot_unit": 4, "ordered_unit_group": 4, "weak_formal_order_group": 4, "sentence_block_group": 6,
    "insertion_context_unit": 6,
}
PLAN: list[Layer] = [
    {
        "plan_base": by_value(
            "candidate_type",
            {
                **{k: weighted(*PLAN_WHOLE) for k in MAIN_TYPES}, "sentence_block_group": weighted(*PLAN_BLOCKS), "insertion_context_unit": weighted(*PLAN_INSERTION),
                "functional_slot_unit": weighted(*PLAN_SLOT), **{k: weighted(*PLAN_ORDER) for k in ORDER_TYPES},
            },
            weighted(*PLAN_BASE),
        ),
        "scope_bonus": first(
            [("covered IS NULL OR n_paragraphs = 0", "0e0")]
            + [(f"candidate_type = '{k}'", f"CASE WHEN {test} THEN {number(yes)} ELSE {number(no)} END") for k, (test, yes, no) in SCOPE.items()]
            + [("candidate_type = 'sentence_block_group' AND composition = 'adjacent_paragraph_pair'", "0.08e0")]
            + [("candidate_type = 'sentence_block_group' AND composition IN ('single_paragraph_window', 'single_paragraph_full')", "0.06e0")],
            "0e0",
        ),
    },
    {"plan_score": rounded(unit("plan_base + scope_bonus + CASE WHEN planned_by_model THEN least(0.1e0, planner_priority * 0.1e0) ELSE 0e0 END"))},
    {"planned": f"plan_score >= {by_value('candidate_type', PLAN_LEAST, 0.45)}"},
]

# Quality: family, candidate_type, n_paragraphs (article), own_paragraphs, n_chars, n_units, tail_distance, blank_position, flags, task scores -----

QUALITY_SIGNALS = (
    "closure_score context_dependency titleability sequence_integrity continuation_openness card_score business_score retrieval_match length_fit object_scope_stability title_namingness "
    "benefit_result_strength enumeration_density structure_completeness meaningfulness task_final"
).split()
# Fixed values.
QUALITY_WEIGHTS = {
    "card_score": 0.56, "business_score": 0.16, "closure_score": 0.14, "greatest(titleability, sequence_integrity, continuation_openness, 1 - context_dependency)": 0.14,
    "retrieval_match": 0.06, "length_fit": 0.14,
}
_WHOLE, _MULTI = "candidate_type = 'whole_passage'", "candidate_type = 'multi_paragraph_unit'"
QUALITY_FAMILY = {
    "title_selection": weighted(
        {"object_scope_stability": 0.06, "title_namingness": 0.06, "benefit_result_strength": 0.08},
        {
            f"{_WHOLE} AND n_paragraphs > 10": -0.22, f"{_MULTI} AND n_paragraphs > 24": -0.14, f"{_MULTI} AND n_paragraphs BETWEEN 13 AND 24 AND own_paragraphs >= 3": -0.08,
            "enumeration_density >= 0.26": -0.12, "enumerative_opening": -0.08, "heading_like": -0.10, "directive_like": -0.08,
        },
    ),
    "sentence_order": weighted(
        {"structure_completeness": 0.10, "meaningfulness": 0.10},
        {
            "candidate_type NOT IN ('sentence_block_group', 'weak_formal_order_group')": -0.35, f"n_units <> {UNITS}": -0.40, f"n_units = {UNITS}": 0.10, "n_chars < 120": -0.12,
            "meaningfulness < 0.60": -0.18, "structure_completeness < 0.60": -0.18,
        },
    ),
    "sentence_fill": weighted(
        {},
        {
            f"{_WHOLE} AND (n_paragraphs > 10 OR n_chars > 1400)": -0.22, f"{_WHOLE} AND blank_position IN ('middle', 'inserted')": -0.10,
            f"{_MULTI} AND own_paragraphs >= 3 AND n_chars > 900": -0.08,
        },
    ),
    "continuation": weighted(
        {},
        {
            f"{_WHOLE} AND (n_paragraphs > 8 OR n_chars > 1400)": -0.28, f"{_MULTI} AND own_paragraphs >= 3 AND n_chars > 900": -0.12, "tail_distance = 0": 0.06, "tail_distance = 1": 0.03,
            "tail_distance >= 3": -0.06,
        },
    ),
}
QUALITY: list[Layer] = [
    {"quality_base": weighted(QUALITY_WEIGHTS), "quality_family": by_value("family", QUALITY_FAMILY, "0e0")},
    {
        "quality": rounded(
            unit(
                "CASE WHEN family IN ('title_selection', 'sentence_fill', 'sentence_order') THEN 0.76e0 * (quality_base + quality_family) + 0.24e0 * task_final"
                " - CASE WHEN task_recommended THEN 0e0 ELSE 0.04e0 END - CASE WHEN task_review THEN 0.02e0 ELSE 0e0 END ELSE quality_base + quality_family END"
            )
        )
    },
]

# Readiness and hints: family, anchor_role, judge_decision, n_units, anchored, canonical ---------------------------------

READY_SIGNALS = (
    "readability bidirectional_validation backward_link_strength forward_link_strength reference_dependency topic_consistency_strength explicit_slot sequence_integrity local_binding_strength "
    "context_closure_score multi_path_risk summary_strength closure_score single_center_strength non_key_detail_density titleability analysis_to_conclusion_strength branch_focus_strength "
    "example_to_theme_strength value_judgement_strength turning_focus_strength object_scope_stability"
).split()
# Weights of main axes and argument structures, and what a label adds.
AXES = {
    "global_abstraction": {"topic_consistency_strength": 0.34, "titleability": 0.22, "object_scope_stability": 0.20, "(1 - branch_focus_strength)": 0.12, "(1 - example_to_theme_strength)": 0.12},
    "final_summary": {"summary_strength": 0.34, "closure_score": 0.28, "analysis_to_conclusion_strength": 0.22, "value_judgement_strength": 0.16},
    "transition_after": {"turning_focus_strength": 0.32, "analysis_to_conclusion_strength": 0.28, "topic_consistency_strength": 0.20, "closure_score": 0.20},
    "solution_conclusion": {"analysis_to_conclusion_strength": 0.34, "value_judgement_strength": 0.26, "closure_score": 0.22, "summary_strength": 0.18},
    "example_elevation": {"example_to_theme_strength": 0.42, "value_judgement_strength": 0.24, "summary_strength": 0.18, "closure_score": 0.16},
}
STRUCTURES = {
    "total_sub": ({"topic_consistency_strength": 0.34, "object_scope_stability": 0.22, "(1 - branch_focus_strength)": 0.22, "titleability": 0.22}, {}),
    "sub_total": ({"summary_strength": 0.34, "closure_score": 0.30, "analysis_to_conclusion_strength": 0.22, "titleability": 0.14}, {}),
    "parallel": ({"branch_focus_strength": 0.42, "topic_consistency_strength": 0.22, "turning_focus_strength": 0.18}, {"structure_label LIKE '%parallel%'": 0.18}),
    "problem_solution": (
        {"analysis_to_conclusion_strength": 0.34, "value_judgement_strength": 0.24, "turning_focus_strength": 0.22},
        {"structure_label LIKE '%problem%' OR structure_label LIKE '%solution%'": 0.20},
    ),
    "example_conclusion": ({"example_to_theme_strength": 0.40, "summary_strength": 0.24, "closure_score": 0.22, "value_judgement_strength": 0.14}, {}),
}
_HELD, _NEGATIVE = "anchor_role = 'review_holdout_boundary'", "anchor_role = 'negative_control'"


def _anchored(name: str, text: str, raised: str, by: float) -> str:
    whole = f"({text} + CASE WHEN {_HELD} THEN {number(by)} ELSE 0e0 END)" if name == raised else f"({text})"
    return f"{whole} * CASE WHEN {_NEGATIVE} THEN 0.72e0 ELSE 1e0 END"


def status(column: str) -> str:
    return reason([(f"{column} >= 0.66", "ready"), (f"{column} >= 0.46", "borderline")], "weak")


HINTS: list[Layer] = [
    {f"axis_{k}": _anchored(k, weighted(w), "transition_after", 0.06) for k, w in AXES.items()},
    {f"form_{k}": _anchored(k, weighted(*w), "parallel", 0.05) for k, w in STRUCTURES.items()},
    {"main_axis": ranked({k: f"axis_{k}" for k in AXES}), "axis_score": rounded(f"greatest({', '.join(f'axis_{k}' for k in AXES)})")},
    {"argument": ranked({k: f"form_{k}" for k in STRUCTURES}), "argument_score": rounded(f"greatest({', '.join(f'form_{k}' for k in STRUCTURES)})")},
]
READINESS: list[Layer] = [
    {
        "anchor_bonus": first([("anchor_role = 'gold_ready_positive'", "0.12e0"), (_NEGATIVE, "-0.18e0")], "-0.06e0"),
        "structure": by_value(
            "family",
            {
                "sentence_fill": mean("bidirectional_validation", "greatest(backward_link_strength, forward_link_strength)", "(1 - reference_dependency)"),
                "sentence_order": mean("sequence_integrity", "local_binding_strength", "context_closure_score", "(1 - multi_path_risk)"),
            },
            mean("topic_consistency_strength", "summary_strength", "closure_score"),
        ),
        "center": by_value("family", {"sentence_fill": "topic_consistency_strength", "sentence_order": "topic_consistency_strength"}, "single_center_strength"),
    },
    {
        "family_match": unit(
            "anchor_bonus + 0.1e0 + "
            + by_value(
                "family",
                {
                    "sentence_fill": weighted({"structure": 0.52, "explicit_slot": 0.12}, {"canonical": 0.26}),
                    "sentence_order": weighted({"structure": 0.50}, {"anchored": 0.20, f"n_units = {UNITS}": 0.12}),
                },
                weighted({"center": 0.48, "structure": 0.24, "(1 - non_key_detail_density)": 0.18}),
            )
        )
    },
    {"ready_base": mean("readability", "structure", "family_match")},
    {
        "ready_judged": first(
            [("judge_decision = 'accept'", "least(1e0, ready_base + 0.08e0)"), (f"judge_decision = 'reject' OR {_NEGATIVE}", "least(ready_base, 0.18e0)")], "ready_base"
        )
    },
    {"ready_held": f"CASE WHEN {_HELD} THEN least(ready_judged, 0.58e0) ELSE ready_judged END"},
    {"readiness": f"CASE WHEN family = 'center_understanding' THEN {mean('ready_held', 'axis_score', 'argument_score')} ELSE {rounded('ready_held')} END"},
    {"readiness_status": f"CASE WHEN {_NEGATIVE} THEN 'blocked' ELSE {status('readiness')} END"},
]

# Selection state, repair advice and bridge score: final, readiness, penalty, difficulty dimensions, band, recommended, needs_review, note -----

BRIDGE_SIGNALS = "quality_score context_dependency retrieval_match length_fit final_score readiness_score role_ambiguity standalone overlong complexity ambiguity depth constraint_intensity".split()
#: Preferences of the caller, -1 to 1, as columns; 0 is neutral.
PREFERENCES = ("prefer_depth", "prefer_constraint", "prefer_clear", "penalty_tolerance", "repair_tolerance")
SELECTION: list[Layer] = [
    {
        "penalty": rounded("role_ambiguity + standalone + overlong"),
        "strongest": "greatest(complexity, ambiguity, depth, constraint_intensity)",
        "top_penalty": reason(
            [
                ("greatest(role_ambiguity, standalone, overlong) <= 0", ""),
                ("role_ambiguity >= standalone AND role_ambiguity >= overlong", "role_ambiguity_penalty"),
                ("standalone >= overlong", "standalone_penalty"),
            ],
            "overlong_penalty",
        ),
    },
    {
        "salvageable": "readiness_score >= 0.45e0 - 0.04e0 * repair_tolerance OR strongest >= 0.62 OR (band IN ('medium', 'hard') AND final_score >= 0.3)",
        "elevated": "penalty >= 0.4e0 + 0.08e0 * penalty_tolerance",
    },
    {
        "clearly_weak": "(final_score < 0.3 AND readiness_score < 0.4) OR (NOT recommended AND readiness_score < 0.35)"
        " OR (NOT salvageable AND penalty >= 0.45e0 + 0.08e0 * penalty_tolerance)"
    },
    {"state": reason([("recommended AND NOT needs_review AND final_score >= 0.5 AND penalty < 0.45", "recommended"), ("clearly_weak", "weak_candidate")], "hold")},
    {
        "review_like_risk": "needs_review OR (readiness_score >= 0.5 AND elevated) OR (state = 'hold' AND penalty >= greatest(0.45e0, 0.55e0 + 0.1e0 * penalty_tolerance))",
        "repair": reason(
            [
                ("state = 'recommended'", ""),
                ("state = 'weak_candidate'", "weak"),
                ("readiness_score >= 0.45e0 - 0.05e0 * repair_tolerance AND penalty >= 0.45e0 + 0.08e0 * penalty_tolerance", "penalty"),
                ("strongest >= greatest(0.58e0, 0.65e0 - 0.06e0 * repair_tolerance) AND top_penalty <> ''", "structure"),
                ("note = 'hard_but_currently_weak_candidate'", "hard"),
            ]
        ),
    },
    {
        "repair_reason": first(
            [
                ("repair = 'hard' OR (repair = 'weak' AND band = 'hard' AND readiness_score >= 0.38 AND note = 'hard_but_currently_weak_candidate')", "'hard_but_currently_weak_candidate'"),
                ("repair IN ('penalty', 'structure') AND top_penalty = 'role_ambiguity_penalty'", "'role_ambiguity_repairable_risk'"),
                ("repair = 'penalty'", "'high_readiness_high_penalty'"),
                ("repair = 'structure'", "concat('structurally_strong_but_', top_penalty)"),
            ],
            "NULL",
        ),
        "decision_reason": reason(
            [
                ("state = 'recommended'", "recommended_stable_candidate"),
                ("recommended AND needs_review", "recommended_candidate_requires_review"),
                ("note = 'hard_but_currently_weak_candidate'", "hard_but_currently_weak_candidate"),
                ("readiness_score >= 0.5 AND elevated", "high_readiness_high_penalty"),
                ("state = 'weak_candidate' AND band <> 'hard' AND penalty >= 0.45", "high_risk_but_not_high_difficulty"),
                ("state = 'weak_candidate' AND band = 'easy'", "easy_but_weak_candidate"),
                ("state = 'hold'", "borderline_hold_candidate"),
            ],
            "overall_weak_candidate",
        ),
    },
]
# What a match, reuse and preferences add to the quality of a candidate.
BRIDGE: list[Layer] = [
    {
        "bridge_base": weighted(
            {"quality_score": 1.0, "(1 - context_dependency)": 0.20},
            {
                "topic_match": 0.08, "direction_match": 0.12, "genre_match": 0.22, "structure_match AND NOT explicit_card": 0.22, "preferred_genre": 0.18,
                "usage_count > 0 AND quality_score >= 0.8 AND prefer_reused": 0.10, "in_cooldown": -0.28, "card_exact AND NOT explicit_card": 0.40,
                "card_recommended AND NOT card_exact AND NOT explicit_card": 0.20, "expected_units > 0 AND n_units <> expected_units AND NOT explicit_card": -0.22,
            },
        ),
        "bridge_reuse": "least(0.36e0, usage_count * 0.08e0)",
        "bridge_search": "0.12e0 * retrieval_match + 0.22e0 * length_fit",
        "bridge_preference": "0.12e0 * prefer_depth * (depth - 0.5e0) + 0.1e0 * prefer_constraint * (constraint_intensity - 0.5e0) + 0.1e0 * prefer_clear * (0.5e0 - ambiguity)"
        " + 0.08e0 * penalty_tolerance * (least(1e0, role_ambiguity + standalone + overlong) - 0.5e0)",
    },
    {"bridge_score": rounded("bridge_base - bridge_reuse + bridge_search + bridge_preference")},
]

# Gates -----------------------------------------------------------------------------------

#: Reads candidate_id, article_id, text, paragraph_range, sentence_range (arrays), family, n_units.
TECHNICAL = reason(
    [
        ("coalesce(candidate_id, '') = ''", "missing_candidate_id"),
        ("coalesce(article_id, '') = ''", "missing_article_id"),
        ("coalesce(trim(text), '') = ''", "empty_candidate_text"),
        ("coalesce(paragraph_ends, 0) <> 2", "paragraph_span_not_traceable"),
        ("coalesce(sentence_ends, 0) <> 2", "sentence_span_not_traceable"),
        ("has_markup", "xml_or_html_residue_detected"),
        ("has_controls", "illegal_control_character_detected"),
        (f"family = 'sentence_order' AND n_units < {UNITS}", "sentence_order_unit_count_below_floor"),
    ]
)
#: Reads the limits of a contract (null: none) beside scores, penalties and dimensions.
CONTRACT = reason(
    [
        ("family NOT IN ('title_selection', 'sentence_fill', 'sentence_order')", ""),
        ("final_score < coalesce(min_final, 0)", "final_candidate_score_below_contract_floor"),
        ("readiness_score < coalesce(min_readiness, 0)", "readiness_score_below_contract_floor"),
        ("role_ambiguity + standalone + overlong > max_penalty", "total_penalty_above_contract_ceiling"),
        ("band_forbidden", "difficulty_band_not_allowed"),
        ("family IN ('title_selection', 'sentence_fill') AND depth < coalesce(min_depth, 0)", "reasoning_depth_below_contract_floor"),
        ("family = 'title_selection' AND ambiguity > max_ambiguity", "ambiguity_above_contract_ceiling"),
        ("family = 'sentence_order' AND complexity < coalesce(min_complexity, 0)", "complexity_below_contract_floor"),
        ("family IN ('sentence_fill', 'sentence_order') AND constraint_intensity < coalesce(min_constraint, 0)", "constraint_intensity_below_contract_floor"),
        ("family = 'sentence_fill' AND role_ambiguity > max_role_ambiguity", "role_ambiguity_penalty_above_contract_ceiling"),
        ("family = 'sentence_fill' AND standalone > max_standalone", "standalone_penalty_above_contract_ceiling"),
    ]
)
#: Reads judge_mode (off, shadow, enforce), judge_accepts, readiness_status, card scores and floors, and the two gates above.
#: The contract's own verdict stays a column of its own, as readiness passes a candidate before the contract is looked at.
RUNTIME = first(
    [
        ("technical <> ''", "technical"),
        ("judged_family AND judge_mode = 'enforce'", "CASE WHEN judge_accepts THEN '' ELSE 'llm_adjudication_rejected' END"),
        ("judged_family AND readiness_status IN ('ready', 'borderline')", "''"),
        ("judged_family AND readiness_status = 'blocked'", "'llm_generation_readiness_blocked'"),
        ("card_score < min_card_score", "'material_card_score_below_threshold'"),
        ("needs_business_card AND business_score < min_business_score", "'business_card_score_below_threshold'"),
    ],
    "contract",
)
WHOLE_SIGNALS = "context_dependency closure_score single_center_strength branch_focus_strength parallel_strength summary_strength titleability".split()
#: Reads own_paragraphs, n_chars, n_paragraphs, article_chars and focused (whether the article has focused candidates).
WHOLE_PASSAGE = reason(
    [
        ("own_paragraphs > 4 OR n_chars > 960 OR n_paragraphs > 4 OR article_chars > 960", "whole_passage_too_wide"),
        ("context_dependency > 0.18", "whole_passage_high_context_dependency"),
        ("closure_score < 0.72", "whole_passage_low_closure"),
        ("single_center_strength < 0.78", "whole_passage_low_focus"),
        ("branch_focus_strength > 0.40 OR parallel_strength > 0.34", "whole_passage_multi_branch"),
        ("focused AND NOT (own_paragraphs <= 2 AND n_chars <= 680 AND summary_strength >= 0.68 AND titleability >= 0.62)", "whole_passage_prefers_focused_units"),
    ],
    "whole_passage_gate_allowed",
)
#: Structure match of fill and order candidates with what is asked for; null: not asked.
STRUCTURE_MATCH = by_value(
    "family",
    {
        "sentence_fill": rounded(
            "least(1e0, "
            + first([("asked_position IS NULL", "0e0"), ("blank_position = asked_position", "0.62e0"), ("keep_position", "0.08e0")], "0e0")
            + " + CASE WHEN function_type = asked_function THEN 0.3e0 ELSE 0e0 END)"
        ),
        "sentence_order": rounded(
            unit(
                first([("asked_units IS NULL", "0e0"), ("n_units = asked_units", "0.6e0"), ("abs(n_units - asked_units) = 1", "0.24e0"), ("keep_units", "CASE WHEN n_units BETWEEN 4 AND 8 THEN 0.1e0 ELSE -0.04e0 END")], "0e0")
                + " + least(0.24e0, shared_modes * 0.08e0) + least(0.16e0, shared_bindings * 0.08e0) + "
                + first([("asked_bindings IS NULL", "0e0"), ("n_bindings >= asked_bindings", "0.1e0"), ("n_bindings + 1 >= asked_bindings", "0.05e0")], "-0.06e0")
                + " + CASE WHEN progression_met THEN 0.08e0 ELSE 0e0 END + CASE WHEN asked_sequence THEN least(0.08e0, 0.08e0 * greatest(temporal_strength, action_strength)) ELSE 0e0 END + "
                + first([("asked_uniqueness IS NULL", "0e0"), ("uniqueness >= asked_uniqueness", "0.1e0"), ("uniqueness + 0.08e0 >= asked_uniqueness", "0.05e0")], "-0.06e0")
            )
        ),
    },
    "0e0",
)
UNIQUENESS = weighted({"unique_opener_score": 0.30, "least(1e0, n_bindings / 3e0)": 0.22, "local_binding_strength": 0.24, "sequence_integrity": 0.24})

# Candidates from outside, affinity to families, flags ---------------------------------------------

#: Reads task_final, structure_match, quality_score, query_match, context_dependency, branch_focus_strength.
EXTERNAL: list[Layer] = [
    {
        "outside_readiness": score({"task_final": 0.40, "structure_match": 0.35, "quality_score": 0.15, "query_match": 0.10}),
        "dependency_penalty": score({"context_dependency": 0.18}),
        "branch_penalty": score({"greatest(0e0, branch_focus_strength - 0.45e0)": 0.10}),
    },
    {"outside_final": score({"outside_readiness": 1.0, "dependency_penalty": -1.0, "branch_penalty": -1.0})},
    {"outside_recommended": "structure_match >= 0.58 AND task_final >= 0.46 AND outside_final >= 0.54"},
    {"outside_review": "NOT outside_recommended AND structure_match >= 0.50 AND outside_readiness >= 0.48 AND outside_final >= 0.42"},
]
# The signals whose mean is a family's affinity.
AFFINITY = {
    "title_selection": ("titleability", "single_center_strength", "core_object_anchor_strength"),
    "continuation": ("continuation_openness", "direction_uniqueness", "tail_extension_signal"),
    "sentence_order": ("opening_signal_strength", "closing_signal_strength", "sequence_integrity"),
    "sentence_fill": ("bidirectional_validation", "reference_dependency", "object_match_strength"),
}
#: Reads best_family_score, independence, continuation_openness, direction_uniqueness, channel.
FLAGS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {condition} THEN '{flag}' END"
    for flag, condition in {
        "low_family_confidence": "best_family_score < 0.45",
        "low_independence": "independence < 0.45",
        "continuation_direction_ambiguous": "continuation_openness > 0.75 AND direction_uniqueness < 0.55",
        "gray_review": "channel = 'gray'",
    }.items()
) + ")"

# How unique an order is: reads best and second opener scores, n_pairs, duplicate_share, directive_share, additive_share, has_closing ------

UNIQUE_SIGNALS = ("best_opener", "second_opener", "duplicate_share", "directive_share", "additive_share")
_PAIRS = "least(1e0, least(4, n_pairs) / 3e0)"
UNIQUENESS_PROFILE: list[Layer] = [
    {
        "opener": score({"best_opener": 0.68, "greatest(0e0, best_opener - second_opener)": 0.32}),
        "overlap": score({"duplicate_share": 0.72, "directive_share": 0.28}),
    },
    {"closure": score({_PAIRS: 0.24, "opener": 0.22, "(1 - overlap)": 0.20}, {"has_closing": 0.34, "NOT has_closing": 0.34 * 0.25})},
    {"exchange": score({"overlap": 0.32, f"(1 - {_PAIRS})": 0.22, "(1 - opener)": 0.20, "(1 - closure)": 0.14, "additive_share": 0.12})},
    {"multi_path": score({"exchange": 0.34, "overlap": 0.22, "(1 - opener)": 0.18, f"(1 - {_PAIRS})": 0.14, "(1 - closure)": 0.12})},
    {"unique_answer": score({"opener": 0.30, _PAIRS: 0.22, "closure": 0.24, "(1 - exchange)": 0.14, "(1 - multi_path)": 0.10})},
]

# Business cards ----------------------------------------------------------------------------

RELATION_SIGNALS = {"turn": "turning_focus_strength", "cause": "cause_effect_strength", "condition": "necessary_condition_strength", "parallel": "parallel_enumeration_strength"}
BUSINESS_SIGNALS = (*RELATION_SIGNALS.values(), "topic_consistency_strength", "marker_hit_ratio", "completeness", "readability")
#: How well an explicit marker shows a relation, best first; conditions on the numbers of markers and where the conclusion stands.
_STATED = "conclusion_position IN ('tail_or_late', 'middle', 'opening')"
SHOWN = {
    "turn": [("n_turn > 0", 0.82)],
    "cause": [("n_cause > 0 AND n_conclusion > 0", 0.88), (f"n_conclusion > 0 AND {_STATED}", 0.74)],
    "condition": [("n_condition > 0", 0.82), (f"n_counter > 0 AND {_STATED}", 0.72)],
    "parallel": [("n_parallel >= 2", 0.80), ("n_parallel = 1", 0.68)],
}
#: Weights of a card that has none of its own.
CARD_WEIGHTS = {"relation": 0.35, "marker": 0.20, "structure": 0.20, "completeness": 0.15, "readability": 0.10}


def relation_match(kind: str) -> str:
    """How well a candidate has the relation of a card; ``theme`` cards ask for one topic only."""
    if kind == "theme":
        return "topic_consistency_strength"
    shown = first([(condition, number(x)) for condition, x in SHOWN[kind]], "0e0")
    return f"CASE WHEN has_{kind} THEN 0.92e0 ELSE greatest({RELATION_SIGNALS[kind]}, {shown}) END"


def business_score(kind: str, marker: bool, structure: dict[str, float], weights: dict[str, float] | None = None, required: bool = False) -> str:
    """The score of a candidate for a card; null if the card's hard filter on the relation turns it away.

    marker: whether the card prefers the markers of its relation; structure: what is worth how much of the structural match.
    """
    relation = f"CASE WHEN has_{kind} THEN 1e0 ELSE ({relation_match(kind)}) END" if required else relation_match(kind)
    parts = {
        "relation": f"({relation})",
        "marker": f"(CASE WHEN n_{kind} > 0 THEN 1e0 ELSE marker_hit_ratio END)" if marker and kind != "theme" else "marker_hit_ratio",
        "structure": f"least(1e0, {weighted({}, structure)})",
        "completeness": "completeness",
        "readability": "readability",
    }
    whole = CARD_WEIGHTS | (weights or {})
    bonus = {"n_conclusion > 0": 0.10, "n_conclusion > 0 AND n_cause > 0": 0.08} if kind == "cause" else {}
    if kind == "theme":
        bonus = {f"greatest({', '.join(RELATION_SIGNALS.values())}) >= 0.58": -0.12}
    text = score({parts[k]: w for k, w in whole.items()}, bonus)
    return f"CASE WHEN ({relation}) < 0.52 THEN NULL ELSE {text} END" if required else text

"""Neutral signals of a span: what stands in its text, as numbers and labels that all rule sets read.

Signals form layers.  The text is cut into sentences and scanned once for all markers; counts are
taken over windows of sentences (the whole text, its head and tail, the first and last two); the
strengths that come from counts are columns of their own; signals are weighted sums of strengths and
of the profile; labels are the first condition that holds.  A layer reads only those before it, so
what several signals share is worked out once.  Nothing is shuffled.

Spans are rows of (span_id, lang, text) with what only their article tells: candidate_type,
document_genre, first_paragraph and last_paragraph (their places in the article; null if unknown),
slot_position and slot_function (of slots whose place and function are set; else null).  Further
columns are passed on by ``observed`` and ``signals``.

Edge cases: a null or empty text has no sentence, counts 0 and the labels of that; languages without
a pack have no markers; whole texts are read; repeated rows are worked out each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import markers as M
from ..functions import text as T
from . import profile, rules
from .rules import first, reason, score

#: The windows and the groups whose strength in them is read: t the text, h and z the first and last sentence, a and e two of each.
STRENGTHS = {
    "t": (
        "counterintuitive timeline turning summary parallel mechanism cause conclusion necessary countermeasure detail benefit theme_raise case macro tension chain connector order_parallel"
    ).split(),
    "h": ["turning"],
    "z": "method_tail tension case macro mechanism theme_raise turning next_step tail_extension".split(),
    "a": ["action", "support"],
    "e": ["closing", "weight"],
}
#: Windows and groups of which it is asked whether they occur.
PRESENT = {"t": ["question"], "h": ["value", "trouble", "closing"], "z": "summary conclude case_tail call forward closing".split(), "m": ["closing"]}
# Words that name no object; a demand at the beginning of a clause.
STOPWORDS = (
    "我们 他们 你们 因为 所以 如果 但是 然而 一个 一种 这个 这些 那些 进行 通过 已经 以及 需要 可以 就是 不是 文章 问题 发展 社会 中国"
).split()
DEMAND = "(?:^|[，。；,;])要(?=[一-鿿]{1,8}(?:加强|完善|做好|避免|推进|坚持|采取|加快))"
#: Least letters of a word that may name an object, where words are spaced.
OBJECT_LETTERS = 4
NO_OBJECT = "unnamed"


def objects(text: Column, lang: Column) -> Column:
    """The words that may name what a text is about, in order."""
    chinese = F.filter(F.regexp_extract_all(text, F.lit("[一-鿿]{2,8}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    return F.when(lang.isin(*L.UNSPACED), chinese).otherwise(F.filter(T.words(text), lambda w: F.length(w) >= OBJECT_LETTERS))


def tallied(rows: DataFrame, out: str, words: Column) -> DataFrame:
    """``rows`` with the different words as (n, word), the most frequent first, of equal ones that which comes first.

    Sorted words stand in runs; a run's length is the distance to the next one's beginning, so the
    work is that of sorting.  Words that all differ need none.
    """
    rows = rows.withColumn("__x_1", F.size(F.array_distinct(words)) == F.size(words))
    again = F.when(F.col("__x_1"), F.slice(words, 1, 0)).otherwise(words)
    placed = F.array_sort(F.transform(again, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("__x_s", placed)
    begins = F.filter(F.transform("__x_s", lambda x, k: F.when((k == 0) | (x["w"] != F.get("__x_s", k - 1)["w"]), k)), lambda k: k.isNotNull())
    rows = rows.withColumn("__x_b", begins)
    runs = F.transform(
        "__x_b",
        lambda b, j: F.struct((b - F.coalesce(F.get("__x_b", j + 1), F.size("__x_s"))).alias("less"), F.get("__x_s", b)["i"].alias("i"), F.get("__x_s", b)["w"].alias("word")),
    )
    each = F.transform(words, lambda w: F.struct(F.lit(1).alias("n"), w.alias("word")))
    rows = rows.withColumn(out, F.when(F.col("__x_1"), each).otherwise(F.transform(F.array_sort(runs), lambda r: F.struct((-r["less"]).alias("n"), r["word"].alias("word")))))
    return rows.drop("__x_s", "__x_b", "__x_1")


def _anchor(counts: str, total: str) -> Column:
    """How much the most frequent object stands out."""
    top = F.get(counts, 0)["n"]
    return F.when(F.size(counts) == 0, 0.0).otherwise(T.rounded(F.least(F.lit(1.0), 0.35 + top / F.greatest(F.lit(4), F.col(total))), 4))


def _scope(counts: str, total: str) -> Column:
    """How evenly the three most frequent objects are spread."""
    spread = F.get(counts, 0)["n"] - F.get(counts, F.least(F.lit(3), F.size(counts)) - 1)["n"]
    return F.when(F.size(counts) <= 1, 0.85).otherwise(T.rounded(F.least(F.lit(1.0), 0.55 + F.least(F.lit(0.30), spread / F.greatest(F.lit(3), F.col(total)))), 4))


def observed(spans: DataFrame) -> DataFrame:
    """Spans with their profile and what stands in their windows: counts, strengths, objects."""
    c = F.col
    # what the article tells rides along as the identifier
    given = [x for x in spans.columns if x not in ("span_id", "lang", "text")]
    packed = spans.select(F.struct("span_id", *given).alias("span_id"), "lang", "text")
    out = profile.profile(packed).withColumn("sents", M.scan(T.sentences(c("body"), c("lang")), c("lang")))
    hits = lambda part: F.array_join(F.transform(part, lambda x: x["hits"]), "")
    sents, n = c("sents"), F.size("sents")
    slice_ = lambda start, size: F.slice(sents, start, size)
    head, tail = F.get(sents, 0), F.get(sents, n - 1)
    windows = {
        "t": hits(sents), "h": F.coalesce(head["hits"], F.lit("")), "z": F.coalesce(tail["hits"], F.lit("")), "a": hits(slice_(1, 2)),
        "e": hits(F.when(n > 1, F.slice(sents, -2, 2)).otherwise(sents)), "m": F.when(n > 2, hits(F.slice(sents, 2, F.greatest(n - 2, F.lit(0))))).otherwise(""),
    }
    out = out.withColumns({f"w_{k}": w for k, w in windows.items()} | {"n_sents": n, "head": F.coalesce(head["text"], F.lit("")), "tail_anchor": F.coalesce(tail["text"], F.lit(""))})
    columns = {f"m_{w}_{g}": M.strength(M.count(c(f"w_{w}"), g)) for w, groups in STRENGTHS.items() for g in groups}
    columns |= {f"p_{w}_{g}": M.has(c(f"w_{w}"), g) for w, groups in PRESENT.items() for g in groups}
    columns |= {f"r_{w}": M.count(c(f"w_{w}"), "reference") for w in "th"}
    ends = F.when(c("lang").isin(*L.UNSPACED), r"[。！？!?]$").otherwise(r"[。！？!?.]$")
    linked = F.filter(F.slice(sents, 2, F.greatest(n - 1, F.lit(0))), lambda x: M.starts(x["start"], "context") | M.starts(x["start"], "linked"))
    results = F.filter(sents, lambda x: F.size(x["benefits"]) > 0)
    columns |= {
        "starts_context": M.starts(F.coalesce(head["start"], F.lit("")), "context"), "n_linked": F.size(linked), "n_results": F.size(results),
        "n_result_words": F.size(F.array_distinct(F.flatten(F.transform(sents, lambda x: x["benefits"])))), "ended": F.regexp_like(c("body"), ends), "tail_ended": F.regexp_like(c("tail_anchor"), ends),
        "demand": c("tail_anchor").rlike(DEMAND), "has_semicolon": c("body").rlike("[；;]"), "has_question_mark": c("body").rlike("[？?]"),
        "n_commas": F.regexp_count("body", F.when(c("lang").isin(*L.UNSPACED), "，").otherwise(",")),
        "global_main_claim": F.coalesce(F.try_element_at(F.filter(sents, lambda x: M.has(x["hits"], "claiming")), F.lit(-1))["text"], tail["text"], F.lit("")),
    }
    out = out.withColumns(columns)
    for name, text in (("body", "body"), ("head", "head"), ("tail", "tail_anchor")):
        out = out.withColumn(f"o_{name}", objects(c(text), c("lang")))
        out = tallied(out, f"c_{name}", c(f"o_{name}")).withColumn(f"k_{name}", F.size(f"o_{name}")).drop(f"o_{name}")
    out = out.withColumns(
        {
            "core_object": F.coalesce(F.get("c_body", 0)["word"], F.lit(NO_OBJECT)), "theme_words": F.transform(F.slice("c_body", 1, 5), lambda x: x["word"]), "core_object_anchor_strength": _anchor("c_body", "k_body"),
            "head_anchor": _anchor("c_head", "k_head"), "tail_object": _anchor("c_tail", "k_tail"), "object_scope_stability": _scope("c_body", "k_body"), "head_size": F.length("head"),
        }
    )
    return out.withColumns({g: c(f"span_id.{g}") for g in given}).withColumn("span_id", c("span_id.span_id"))


_REFERENCE = "r_{0} * 0.18e0 + CASE WHEN r_{0} > 0 THEN 0.22e0 ELSE 0e0 END"
#: Places and functions that a slot can have together, with the relation that goes with each.
# Fixed values.
SLOTS = {
    ("opening", "summary"): "summary", ("opening", "topic_intro"): "transition", ("middle", "carry_previous"): "explanation", ("middle", "lead_next"): "transition",
    ("middle", "bridge"): "continuation", ("ending", "conclusion"): "summary", ("ending", "countermeasure"): "action",
}
_SLOT = [(f"slot_position = '{p}' AND slot_function = '{f}'", f, r) for (p, f), r in SLOTS.items()]

# Weights, thresholds and labels.
LAYERS: list[rules.Layer] = [
    {
        "context_dependency": score({"independence": -1.0}, base=1.0),
        "closure_score": score({"summary": 0.35, "readability": 0.30, "independence": 0.20}, {"ended": 0.15, "NOT ended": 0.06}),
        "semantic_completeness_score": score({"independence": 0.40, "readability": 0.35}, {"ended": 0.25, "NOT ended": 0.0875}),
        "cause_effect_strength": score({"m_t_cause": 0.5, "m_t_conclusion": 0.5}),
        "parallel_enumeration_strength": score({"m_t_parallel": 1.0}, {"has_semicolon": 0.10}),
        "non_key_detail_density": score({"m_t_detail": 0.55, "(1 - summary)": 0.45}),
        "turning_focus_strength": score({"m_t_turning": 0.55, "transition": 0.45}),
        "multi_dimension_cohesion": score({"m_t_parallel": 0.50, "branch": 0.50}),
        "benefit_result_count": score({"least(1e0, n_results / 3e0)": 0.55, "least(1e0, n_result_words / 3e0)": 0.45}),
        "case_macro_shift_strength": score({"m_t_case": 0.45, "m_t_macro": 0.55}),
        "tail_shift": score({"m_z_case": 0.45, "m_z_macro": 0.55}),
        "continuation_openness": "round(greatest(openness, m_z_tail_extension) + 1e-9, 4)",
        "reference_dependency": rules.rounded(rules.unit(_REFERENCE.format("t"))),
        "head_dependency": rules.rounded(rules.unit(_REFERENCE.format("h"))),
        "forward_link_strength": score({"m_z_tail_extension": 0.40}, {"p_z_forward": 0.15}, 0.35),
        "anchor_clarity": score({"tail_object": 0.30}, {"tail_ended": 0.35}, 0.35),
        "abstraction_level": score({"summary": 0.40, "value": 0.30, "m_t_summary": 0.30}),
        "elevation_space_strength": score({"value": 0.40, "summary": 0.30, "m_t_summary": 0.30}),
        "local_binding_strength": "CASE WHEN n_sents <= 1 THEN 0.3e0 ELSE " + rules.rounded("least(1e0, 0.35e0 + CAST(n_linked AS DOUBLE) / (n_sents - 1) * 0.55e0)") + " END",
        "block_order_complexity": score({"m_t_parallel": 0.18, "branch": 0.18, "problem": 0.12}, {"candidate_type = 'sentence_block_group'": 0.14}, 0.30),
        "article_purpose_frame": reason(
            [
                ("problem >= 0.65 AND method >= 0.55", "problem_judgement"), ("value >= 0.70", "comment"), ("m_t_counterintuitive >= 0.48", "correction"), ("m_t_timeline >= 0.48", "development"),
                ("example >= 0.65 OR branch >= 0.65", "many_sided"),
            ],
            "explanation",
        ),
        "discourse_shape": reason(
            [
                ("m_t_turning >= 0.48", "turn_to_point"), ("m_t_timeline >= 0.48", "in_time"), ("m_t_parallel >= 0.48", "parallel"), ("problem >= 0.62", "problem_analysis_conclusion"),
                ("example >= 0.62", "case_raised"),
            ],
            "general_parts",
        ),
        "opening_anchor_type": reason(
            [
                ("starts_context", "upper_context_link"), ("p_h_value", "viewpoint_opening"), ("p_h_trouble", "problem_opening"), ("head_anchor >= 0.60", "explicit_topic"), ("head_size <= 14", "weak_opening"),
            ],
            "none",
        ),
        "closing_anchor_type": reason([("p_z_call OR demand", "call_to_action"), ("p_z_summary", "summary"), ("p_z_conclude", "conclusion"), ("p_z_case_tail", "case_support")], "none"),
        "conclusion_position": reason([("n_sents = 0", "unknown"), ("p_z_closing", "tail_or_late"), ("p_h_closing", "opening"), ("p_m_closing", "middle")], "distributed"),
        "blank_position": first(
            [
                ("coalesce(slot_position, '') <> ''", "slot_position"), ("candidate_type = 'insertion_context_unit'", "'inserted'"), ("first_paragraph = 0", "'opening'"),
                ("last_paragraph >= 2", "'ending'"),
            ],
            "'middle'",
        ),
        "slot_explicit_ready": "candidate_type = 'functional_slot_unit' AND coalesce(slot_position, '') <> '' AND coalesce(slot_function, '') <> ''",
    },
    {
        "opening_signal_strength": rules.by_value(
            "opening_anchor_type", {"explicit_topic": 0.82, "viewpoint_opening": 0.76, "problem_opening": 0.72, "upper_context_link": 0.60, "weak_opening": 0.42}, 0.28
        ),
        "closing_signal_strength": rules.by_value("closing_anchor_type", {"conclusion": 0.84, "summary": 0.80, "call_to_action": 0.76, "case_support": 0.58}, 0.24),
        "non_opening_penalty": score({}, {"starts_context": 0.45, "m_h_turning >= 0.30": 0.25, "head_dependency >= 0.60": 0.20}),
        "backward_link_strength": "CASE WHEN starts_context THEN 0.78e0 WHEN head_dependency >= 0.45 THEN 0.62e0 ELSE 0.42e0 END",
        "focus_shift_strength": score({"turning_focus_strength": 0.60, "transition": 0.40}),
        "analysis_to_conclusion_strength": score({"problem": 0.28, "summary": 0.28, "m_t_summary": 0.24, "benefit_result_count": 0.20}),
        "action_anchor": "least(1e0, 0.60e0 * m_a_action + 0.40e0 * m_a_support)",
        "title_namingness": score({"titleability": 0.45, "core_object_anchor_strength": 0.35, "(1 - least(1e0, n_commas / 6e0))": 0.20}, {"n > 280": -0.12}),
        "summary_need_strength": "CASE blank_position WHEN 'opening' THEN " + score({"summary": 0.45}, base=0.45) + " WHEN 'ending' THEN " + score({"summary": 0.35}, base=0.50) + " ELSE " + score({"summary": 0.25}, base=0.20) + " END",
        "key_sentence_position": "CASE WHEN summary >= 0.60 THEN conclusion_position WHEN turning_focus_strength >= 0.55 THEN 'tail_or_late' ELSE 'distributed' END",
        "title_rhetoric_form": reason(
            [
                ("has_question_mark OR p_t_question", "question"), ("m_t_turning >= 0.48", "contrast"), ("value >= 0.68 OR m_t_counterintuitive >= 0.48", "judgement"), ("summary >= 0.68 AND value >= 0.58", "abstract"),
                ("core_object_anchor_strength >= 0.72 AND titleability >= 0.68", "direct_label"),
            ],
            "thematic",
        ),
        "anchor_focus": reason(
            [
                ("m_z_method_tail >= 0.45", "method_opening"), ("m_z_tension >= 0.45", "tension_retained"), ("tail_shift >= 0.45", "macro_shift"), ("branch >= 0.68", "branch_focus"),
                ("problem >= 0.65 AND method >= 0.50", "problem_exposed"), ("m_z_mechanism >= 0.40", "mechanism_named"), ("m_z_theme_raise >= 0.48", "theme_raised"), ("value >= 0.68", "judgement_given"),
                ("p_z_summary", "new_pivot"),
            ],
            "tail_anchor",
        ),
        "continuation_type": reason(
            [
                ("problem >= 0.72 AND method >= 0.50", "countermeasure"), ("m_t_mechanism >= 0.60", "deepen_mechanism"), ("m_t_theme_raise >= 0.60", "subtopic_expand"), ("value >= 0.68", "reason_argument"),
                ("case_macro_shift_strength >= 0.60", "macro_unfold"), ("branch >= 0.68", "focus_branch"), ("m_t_tension >= 0.60", "resolve_tension"), ("method >= 0.68", "method_expand"),
                ("m_z_tail_extension >= 0.70", "explain"),
            ],
            "deepen_pivot",
        ),
        "ending_function": reason(
            [
                ("m_z_tension >= 0.48", "tension_hold"), ("p_z_summary AND m_z_tail_extension >= 0.45", "summary_plus_open"), ("value >= 0.68", "judgement_trigger"),
                ("m_z_turning >= 0.40 OR m_z_next_step >= 0.40", "transition_trigger"),
            ],
            "open_only",
        ),
        "middle_structure_type": reason(
            [
                ("m_t_parallel >= 0.48", "parallel_expansion"), ("problem >= 0.62 AND method >= 0.48", "problem_solution_blocks"), ("m_t_chain >= 0.42", "cause_effect_chain"),
                ("local_binding_strength >= 0.58", "local_binding"),
            ],
            "mixed_layers",
        ),
    },
    {
        "multi_constraint_density": rules.mean("reference_dependency", "backward_link_strength", "forward_link_strength"),
        "bidirectional_validation": rules.mean("backward_link_strength", "forward_link_strength"),
        "sequence_integrity": score({"opening_signal_strength": 0.28, "closing_signal_strength": 0.24, "local_binding_strength": 0.24, "(1 - non_opening_penalty)": 0.24}),
        "insertion_fit_strength": "CASE WHEN candidate_type <> 'insertion_context_unit' THEN 0.18e0 ELSE " + score({"reference_dependency": 0.40, "backward_link_strength": 0.30, "forward_link_strength": 0.30}) + " END",
        "benefit_result_strength": "CASE WHEN n_sents = 0 THEN 0e0 ELSE "
        + score(
            {
                "action_anchor": 0.24, "benefit_result_count": 0.26, "m_t_benefit": 0.20, "(0.55e0 * summary + 0.45e0 * m_e_closing)": 0.16, "(0.55e0 * value + 0.45e0 * m_e_weight)": 0.14,
                "greatest(0e0, turning_focus_strength - 0.62e0)": -0.12, "greatest(0e0, problem - 0.66e0)": -0.10, "greatest(0e0, parallel_enumeration_strength - 0.72e0)": -0.08,
            }
        )
        + " END",
        "progression_mode": rules.by_value(
            "continuation_type",
            {
                "explain": "'one_level_down'", "countermeasure": "'problem_to_solution'", "deepen_mechanism": "'object_to_mechanism'", "subtopic_expand": "'theme_to_subtopic'", "deepen_pivot": "'summary_to_new_pivot'",
                "reason_argument": "'judgement_to_reason'", "macro_unfold": "'case_to_macro'", "focus_branch": "'multi_branch_to_focus'", "resolve_tension": "'tension_to_explanation'", "method_expand": "'analysis_to_method'",
            },
            "'one_level_down'",
        ),
        "logic_relations": "array_compact(array(CASE WHEN turning_focus_strength >= 0.50 THEN 'turn' END, CASE WHEN cause_effect_strength >= 0.50 THEN 'cause' END, "
        "CASE WHEN m_t_necessary >= 0.50 THEN 'condition' END, CASE WHEN parallel_enumeration_strength >= 0.50 THEN 'parallel' END))",
    },
    {
        "function_type": first(
            [
                *((where, f"'{f}'") for where, f, _ in _SLOT), ("candidate_type = 'insertion_context_unit'", "'reference_summary'"), ("blank_position = 'opening' AND summary >= 0.58", "'summary'"),
                ("blank_position = 'ending'", "'conclusion'"), ("explanation >= 0.66", "'carry_previous'"), ("focus_shift_strength >= 0.62", "'lead_next'"),
            ],
            "'bridge'",
        ),
        "material_structure_label": first(
            [
                ("benefit_result_strength >= 0.66", "'action_to_result'"), ("cause_effect_strength >= 0.52", "'phenomenon_analysis'"), ("turning_focus_strength >= 0.52", "'background_to_point'"),
                ("parallel_enumeration_strength >= 0.52", "'parallel'"), ("value >= 0.62", "'claim_argument'"),
            ],
            "discourse_shape",
        ),
    },
    {
        "logic_relation": first(
            [
                *((where, f"'{r}'") for where, _, r in _SLOT), ("function_type = 'countermeasure'", "'action'"), ("function_type = 'conclusion' AND elevation_space_strength >= 0.62", "'elevation'"),
                ("function_type IN ('summary', 'conclusion')", "'summary'"), ("function_type = 'carry_previous'", "'explanation'"), ("function_type = 'lead_next'", "'focus_shift'"),
                ("function_type = 'reference_summary'", "'reference_match'"), ("multi_constraint_density >= 0.70", "'multi_constraint'"), ("m_t_connector >= 0.45 OR turning_focus_strength >= 0.45", "'transition'"),
            ],
            "'continuation'",
        ),
    },
]

#: Signals that are columns of another name.
NAMED = {
    "single_center_strength": "center", "summary_strength": "summary", "value_judgement_strength": "value", "judgement_signal_strength": "value", "example_to_theme_strength": "example",
    "problem_signal_strength": "problem", "method_signal_strength": "method", "branch_focus_strength": "branch", "direction_uniqueness": "uniqueness", "explanation_need_strength": "explanation",
    "standalone_readability": "readability", "titleability": "titleability", "counterintuitive_strength": "m_t_counterintuitive", "timeline_strength": "m_t_timeline", "mechanism_signal_strength": "m_t_mechanism",
    "theme_raise_strength": "m_t_theme_raise", "tension_signal_strength": "m_t_tension", "tail_extension_signal": "m_z_tail_extension", "connector_signal_strength": "m_t_connector",
    "necessary_condition_strength": "m_t_necessary", "countermeasure_signal_strength": "m_t_countermeasure", "object_match_strength": "core_object_anchor_strength", "topic_consistency_strength": "object_scope_stability",
    "tail_settlement_strength": "closing_signal_strength",
}
#: Numbers, labels and texts of ``neutral_signals``.
NUMBERS = (
    "closure_score context_dependency core_object_anchor_strength object_scope_stability turning_focus_strength multi_dimension_cohesion analysis_to_conclusion_strength title_namingness continuation_openness "
    "anchor_clarity case_macro_shift_strength opening_signal_strength non_opening_penalty local_binding_strength closing_signal_strength block_order_complexity sequence_integrity bidirectional_validation "
    "reference_dependency abstraction_level backward_link_strength forward_link_strength summary_need_strength focus_shift_strength elevation_space_strength insertion_fit_strength multi_constraint_density "
    "semantic_completeness_score cause_effect_strength parallel_enumeration_strength benefit_result_strength benefit_result_count non_key_detail_density"
).split()
LABELS = (
    "candidate_type document_genre article_purpose_frame discourse_shape core_object global_main_claim title_rhetoric_form tail_anchor anchor_focus continuation_type progression_mode ending_function "
    "opening_anchor_type middle_structure_type closing_anchor_type slot_explicit_ready blank_position function_type logic_relation logic_relations material_structure_label theme_words key_sentence_position"
).split()


def signals(spans: DataFrame) -> DataFrame:
    """Spans with all signals under their names, for rule sets to read."""
    out = rules.apply(observed(spans), LAYERS)
    return out.withColumns({name: F.round(F.col(column) + 1e-9, 4) for name, column in NAMED.items()})


def neutral_signals(spans: DataFrame) -> DataFrame:
    """span_id, lang and all signals but those of units in an order; see ``order_signals``."""
    return signals(spans).select("span_id", "lang", *LABELS, *NUMBERS, *NAMED)

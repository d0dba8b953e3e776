"""Neutral signals and order signals of documents, with their SQL.

Documents are spans.  What their articles would tell goes by their identifiers: the kind of
candidate, its place among paragraphs, and place and function of slots.  The SQL counts every
marker by itself, where the operator scans for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import markers as M
from ..operators import genre, neutral, scoring
from ..operators import order_signals as orders
from .catalogue import GENRES, PROFILE, SENTS, WORDS, _sql_genres, query, t

KINDS = scoring.CANDIDATE_TYPES
SLOTS = (*neutral.SLOTS, ("opening", "bridge"), ("", ""))


def given_spans(spark, sf_dir: str) -> DataFrame:
    """Documents as spans, with what their articles tell."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    turn = F.floor(F.col("doc_id") / 5)
    slot = F.get(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p, f in SLOTS)), (turn % len(SLOTS)).cast("int"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))
    docs = docs.withColumns({"candidate_type": kind, "first_paragraph": turn % 4, "document_genre": genre.best_genre(F.substring("text", 1, 60), F.col("text"), F.col("source"), GENRES, "general")})
    is_slot = F.col("candidate_type") == "functional_slot_unit"
    return docs.select(
        F.col("doc_id").alias("span_id"), "lang", "text", F.col("source").alias("article_id"), "candidate_type", "document_genre", "first_paragraph", (F.col("first_paragraph") + 1).alias("last_paragraph"),
        F.when(is_slot, slot["p"]).alias("slot_position"), F.when(is_slot, slot["f"]).alias("slot_function"),
    )


def _hay(text: str) -> str:
    """Words with a space of their own on either side; Chinese as it stands."""
    return f"CASE WHEN lang = 'zh' THEN {text} ELSE ' ' || array_to_string({WORDS.format(text)}, '  ') || ' ' END"


def _padded(lang: str, m: str) -> str:
    return m if lang in L.UNSPACED else f" {m.replace(' ', '  ')} "


def _each(group: str, item: str, glue: str, none: str) -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {glue.join(item.format(m=_padded(lang, m), w=m, n=len(_padded(lang, m))) for m in M.markers(lang, group)) or none}" for lang in L.PACKS)
    return f"coalesce(CASE lang {cases} END, {none})"


def _n(window: str, group: str) -> str:
    return _each(group, f"(length({window}) - length(replace({window}, '{{m}}', ''))) // {{n}}", " + ", "0")


def _m(window: str, group: str) -> str:
    return f"round(least(1.0, {_n(window, group)} * 0.18::DOUBLE + CASE WHEN {_n(window, group)} > 0 THEN 0.30::DOUBLE ELSE 0 END), 4)::DOUBLE"


def _has(window: str, group: str) -> str:
    return _each(group, f"contains({window}, '{{m}}')", " OR ", "false")


def _starts(window: str, group: str) -> str:
    return _each(group, f"starts_with({window}, '{{m}}')", " OR ", "false")


def _list(group: str, window: str) -> str:
    """The markers of the group that occur, in order."""
    cases = " ".join(f"WHEN '{lang}' THEN list_filter([{', '.join(f'CASE WHEN contains({window}, {chr(39)}{_padded(lang, m)}{chr(39)}) THEN {chr(39)}{m}{chr(39)} END' for m in M.markers(lang, group))}], lambda z: z IS NOT NULL)" for lang in L.PACKS)
    return f"CASE lang {cases} ELSE [] END"


def _r4(x: str) -> str:
    return f"round(greatest(0::DOUBLE, least(1::DOUBLE, {x})) + 1e-9::DOUBLE, 4)"


def _tally(name: str, text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in neutral.STOPWORDS)
    words = f"CASE WHEN lang = 'zh' THEN list_filter(regexp_extract_all({text}, '[一-鿿]{{2,8}}'), lambda w: w NOT IN ({stop})) ELSE list_filter({WORDS.format(text)}, lambda w: length(w) >= {neutral.OBJECT_LETTERS}) END"
    return f"""{name}_w AS (SELECT span_id, {words} AS o FROM w), {name}_u AS (SELECT span_id, unnest(o) AS x, generate_subscripts(o, 1) AS i FROM {name}_w),
        {name}_g AS (SELECT span_id, x, count(*) AS n, min(i) AS i FROM {name}_u GROUP BY ALL), {name} AS (SELECT span_id, array_agg(x ORDER BY n DESC, i) AS xs, array_agg(n ORDER BY n DESC, i) AS ns, sum(n) AS k FROM {name}_g GROUP BY 1)"""


def _anchor(name: str) -> str:
    return f"CASE WHEN {name}.k IS NULL THEN 0::DOUBLE ELSE round(least(1::DOUBLE, 0.35::DOUBLE + {name}.ns[1] / greatest(4, {name}.k)) + 1e-9::DOUBLE, 4) END"


DEMAND = neutral.DEMAND.replace("(?=", "(?:")
KIND_SQL = f"[{', '.join(repr(k) for k in KINDS)}][(span_id % {len(KINDS)} + 1)::INT]"
SLOT_SQL = "[" + ", ".join(f"{{'p': '{p}', 'f': '{f}'}}" for p, f in SLOTS) + f"][((span_id // 5) % {len(SLOTS)} + 1)::INT]"
GIVEN = f"""{PROFILE}, gs AS (SELECT id AS span_id, genre FROM ({_sql_genres()}) WHERE rank = 1),
    kd AS (SELECT *, {KIND_SQL} AS candidate_type FROM pr),
    gv AS (SELECT *, (span_id // 5) % 4 AS first_paragraph, (span_id // 5) % 4 + 1 AS last_paragraph,
        CASE WHEN candidate_type = 'functional_slot_unit' THEN {SLOT_SQL}.p END AS slot_position, CASE WHEN candidate_type = 'functional_slot_unit' THEN {SLOT_SQL}.f END AS slot_function, {SENTS} AS ss FROM kd JOIN gs USING (span_id))"""
_REF = "least(1::DOUBLE, r{0} * 0.18::DOUBLE + CASE WHEN r{0} > 0 THEN 0.22::DOUBLE ELSE 0 END)"


def _pair(values: dict[str, str]) -> str:
    return " ".join(f"WHEN slot_position = '{k.split('/')[0]}' AND slot_function = '{k.split('/')[1]}' THEN '{v}'" for k, v in values.items())


OBSERVED = f"""{GIVEN}, hs AS (SELECT *, list_transform(ss, lambda x: {_hay('x')}) AS hh, len(ss) AS ns FROM gv),
    w AS (SELECT *, coalesce(array_to_string(hh, '|'), '') AS wt, coalesce(hh[1], '') AS wh, coalesce(hh[ns], '') AS wz, coalesce(array_to_string(hh[1:2], '|'), '') AS wa,
        coalesce(array_to_string(CASE WHEN ns > 1 THEN hh[ns - 1:ns] ELSE hh END, '|'), '') AS we, CASE WHEN ns > 2 THEN array_to_string(hh[2:ns - 1], '|') ELSE '' END AS wm,
        coalesce(ss[1], '') AS head, coalesce(ss[ns], '') AS tail_anchor FROM hs),
    {_tally('ob', 'body')}, {_tally('oh', 'head')}, {_tally('oz', 'tail_anchor')},
    o AS (SELECT w.*, {_anchor('ob')} AS core_object_anchor_strength, {_anchor('oh')} AS head_anchor, {_anchor('oz')} AS tail_object,
        CASE WHEN coalesce(len(ob.ns), 0) <= 1 THEN 0.85::DOUBLE ELSE round(least(1::DOUBLE, 0.55::DOUBLE + least(0.30::DOUBLE, (ob.ns[1] - ob.ns[least(3, len(ob.ns))]) / greatest(3, ob.k))) + 1e-9::DOUBLE, 4) END AS object_scope_stability,
        coalesce(ob.xs[1], 'unnamed') AS core_object, coalesce(ob.xs[1:5], []) AS theme_words
        FROM w LEFT JOIN ob USING (span_id) LEFT JOIN oh USING (span_id) LEFT JOIN oz USING (span_id)),
    k AS (SELECT *, {', '.join(f"{_m('wt', g)} AS t_{g}" for g in neutral.STRENGTHS['t'])}, {_m('wh', 'turning')} AS h_turning, {', '.join(f"{_m('wz', g)} AS z_{g}" for g in neutral.STRENGTHS['z'])},
        {_m('wa', 'action')} AS a_action, {_m('wa', 'support')} AS a_support, {_m('we', 'closing')} AS e_closing, {_m('we', 'weight')} AS e_weight,
        {_n('wt', 'reference')} AS rt, {_n('wh', 'reference')} AS rh, {_starts('wh', 'context')} AS opens_in_context,
        len(list_filter(hh[2:], lambda x: {_starts('x', 'context')} OR {_starts('x', 'linked')})) AS linked,
        list_transform(hh, lambda x: CASE WHEN {_has('x', 'benefit')} THEN ({_list('benefit', 'x')})[1:2] WHEN {_has('x', 'benefit_noun')} AND {_has('x', 'benefit_degree')} THEN ({_list('benefit_noun', 'x')})[1:2] ELSE [] END) AS gains,
        CASE WHEN lang = 'zh' THEN regexp_matches(body, '[。！？!?]$') ELSE regexp_matches(body, '[。！？!?.]$') END AS ended,
        CASE WHEN lang = 'zh' THEN regexp_matches(tail_anchor, '[。！？!?]$') ELSE regexp_matches(tail_anchor, '[。！？!?.]$') END AS tail_ended,
        list_filter(range(1, ns + 1), lambda i: {_has('hh[i]', 'claiming')}) AS claims FROM o)"""

FIRST = f"""f1 AS (SELECT *, {_r4('1 - independence')} AS context_dependency,
        {_r4('0.35::DOUBLE * summary + 0.30::DOUBLE * readability + 0.20::DOUBLE * independence + 0.15::DOUBLE * CASE WHEN ended THEN 1::DOUBLE ELSE 0.4::DOUBLE END')} AS closure_score,
        {_r4('0.40::DOUBLE * independence + 0.35::DOUBLE * readability + 0.25::DOUBLE * CASE WHEN ended THEN 1::DOUBLE ELSE 0.35::DOUBLE END')} AS semantic_completeness_score,
        {_r4('(t_cause + t_conclusion) / 2')} AS cause_effect_strength,
        {_r4("t_parallel + CASE WHEN contains(body, ';') OR contains(body, '；') THEN 0.1::DOUBLE ELSE 0 END")} AS parallel_enumeration_strength,
        {_r4('0.55::DOUBLE * t_detail + 0.45::DOUBLE * (1 - summary)')} AS non_key_detail_density, {_r4('0.55::DOUBLE * t_turning + 0.45::DOUBLE * transition')} AS turning_focus_strength,
        {_r4('0.5::DOUBLE * t_parallel + 0.5::DOUBLE * branch')} AS multi_dimension_cohesion,
        {_r4('0.55::DOUBLE * least(1::DOUBLE, len(list_filter(gains, lambda x: len(x) > 0)) / 3) + 0.45::DOUBLE * least(1::DOUBLE, len(list_distinct(flatten(gains))) / 3)')} AS benefit_result_count,
        {_r4('0.45::DOUBLE * t_case + 0.55::DOUBLE * t_macro')} AS case_macro_shift_strength, {_r4('0.45::DOUBLE * z_case + 0.55::DOUBLE * z_macro')} AS tail_shift,
        round(greatest(openness, z_tail_extension) + 1e-9::DOUBLE, 4) AS continuation_openness, {_r4(_REF.format('t'))} AS reference_dependency, {_r4(_REF.format('h'))} AS head_dependency,
        {_r4(f"0.35::DOUBLE + 0.40::DOUBLE * z_tail_extension + CASE WHEN {_has('wz', 'forward')} THEN 0.15::DOUBLE ELSE 0 END")} AS forward_link_strength,
        {_r4('0.35::DOUBLE + CASE WHEN tail_ended THEN 0.35::DOUBLE ELSE 0 END + 0.30::DOUBLE * tail_object')} AS anchor_clarity,
        {_r4('0.40::DOUBLE * summary + 0.30::DOUBLE * value + 0.30::DOUBLE * t_summary')} AS abstraction_level, {_r4('0.40::DOUBLE * value + 0.30::DOUBLE * summary + 0.30::DOUBLE * t_summary')} AS elevation_space_strength,
        CASE WHEN ns <= 1 THEN 0.3::DOUBLE ELSE {_r4('0.35::DOUBLE + linked / (ns - 1) * 0.55::DOUBLE')} END AS local_binding_strength,
        {_r4("0.30::DOUBLE + CASE candidate_type WHEN 'sentence_block_group' THEN 0.14::DOUBLE ELSE 0 END + 0.18::DOUBLE * t_parallel + 0.18::DOUBLE * branch + 0.12::DOUBLE * problem")} AS block_order_complexity,
        CASE WHEN problem >= 0.65 AND method >= 0.55 THEN 'problem_judgement' WHEN value >= 0.7 THEN 'comment' WHEN t_counterintuitive >= 0.48 THEN 'correction' WHEN t_timeline >= 0.48 THEN 'development'
             WHEN example >= 0.65 OR branch >= 0.65 THEN 'many_sided' ELSE 'explanation' END AS article_purpose_frame,
        CASE WHEN t_turning >= 0.48 THEN 'turn_to_point' WHEN t_timeline >= 0.48 THEN 'in_time' WHEN t_parallel >= 0.48 THEN 'parallel' WHEN problem >= 0.62 THEN 'problem_analysis_conclusion' WHEN example >= 0.62 THEN 'case_raised'
             ELSE 'general_parts' END AS discourse_shape,
        CASE WHEN opens_in_context THEN 'upper_context_link' WHEN {_has('wh', 'value')} THEN 'viewpoint_opening' WHEN {_has('wh', 'trouble')} THEN 'problem_opening' WHEN head_anchor >= 0.6 THEN 'explicit_topic'
             WHEN length(head) <= 14 THEN 'weak_opening' ELSE 'none' END AS opening_anchor_type,
        CASE WHEN {_has('wz', 'call')} OR regexp_matches(tail_anchor, '{DEMAND}') THEN 'call_to_action' WHEN {_has('wz', 'summary')} THEN 'summary' WHEN {_has('wz', 'conclude')} THEN 'conclusion' WHEN {_has('wz', 'case_tail')} THEN 'case_support'
             ELSE 'none' END AS closing_anchor_type,
        CASE WHEN ns = 0 THEN 'unknown' WHEN {_has('wz', 'closing')} THEN 'tail_or_late' WHEN {_has('wh', 'closing')} THEN 'opening' WHEN {_has('wm', 'closing')} THEN 'middle' ELSE 'distributed' END AS conclusion_position,
        CASE WHEN coalesce(slot_position, '') <> '' THEN slot_position WHEN candidate_type = 'insertion_context_unit' THEN 'inserted' WHEN first_paragraph = 0 THEN 'opening' WHEN last_paragraph >= 2 THEN 'ending' ELSE 'middle' END AS blank_position,
        candidate_type = 'functional_slot_unit' AND coalesce(slot_position, '') <> '' AND coalesce(slot_function, '') <> '' AS slot_explicit_ready
    FROM k)"""
SECOND = f"""f2 AS (SELECT *,
        CASE opening_anchor_type WHEN 'explicit_topic' THEN 0.82 WHEN 'viewpoint_opening' THEN 0.76 WHEN 'problem_opening' THEN 0.72 WHEN 'upper_context_link' THEN 0.60 WHEN 'weak_opening' THEN 0.42 ELSE 0.28 END::DOUBLE AS opening_signal_strength,
        CASE closing_anchor_type WHEN 'conclusion' THEN 0.84 WHEN 'summary' THEN 0.80 WHEN 'call_to_action' THEN 0.76 WHEN 'case_support' THEN 0.58 ELSE 0.24 END::DOUBLE AS closing_signal_strength,
        {_r4('CASE WHEN opens_in_context THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN h_turning >= 0.3 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN head_dependency >= 0.6 THEN 0.2::DOUBLE ELSE 0 END')} AS non_opening_penalty,
        CASE WHEN opens_in_context THEN 0.78 WHEN head_dependency >= 0.45 THEN 0.62 ELSE 0.42 END::DOUBLE AS backward_link_strength,
        {_r4('0.6::DOUBLE * turning_focus_strength + 0.4::DOUBLE * transition')} AS focus_shift_strength,
        {_r4('0.28::DOUBLE * problem + 0.28::DOUBLE * summary + 0.24::DOUBLE * t_summary + 0.20::DOUBLE * benefit_result_count')} AS analysis_to_conclusion_strength,
        {_r4("0.45::DOUBLE * titleability + 0.35::DOUBLE * core_object_anchor_strength + 0.2::DOUBLE * (1 - least(1::DOUBLE, (length(body) - length(replace(body, CASE WHEN lang = 'zh' THEN '，' ELSE ',' END, ''))) / 6)) - CASE WHEN n > 280 THEN 0.12::DOUBLE ELSE 0 END")} AS title_namingness,
        CASE blank_position WHEN 'opening' THEN {_r4('0.45::DOUBLE + 0.45::DOUBLE * summary')} WHEN 'ending' THEN {_r4('0.5::DOUBLE + 0.35::DOUBLE * summary')} ELSE {_r4('0.2::DOUBLE + 0.25::DOUBLE * summary')} END AS summary_need_strength,
        CASE WHEN summary >= 0.6 THEN conclusion_position WHEN turning_focus_strength >= 0.55 THEN 'tail_or_late' ELSE 'distributed' END AS key_sentence_position,
        CASE WHEN regexp_matches(body, '[？?]') OR {_has('wt', 'question')} THEN 'question' WHEN t_turning >= 0.48 THEN 'contrast' WHEN value >= 0.68 OR t_counterintuitive >= 0.48 THEN 'judgement' WHEN summary >= 0.68 AND value >= 0.58 THEN 'abstract'
             WHEN core_object_anchor_strength >= 0.72 AND titleability >= 0.68 THEN 'direct_label' ELSE 'thematic' END AS title_rhetoric_form,
        CASE WHEN z_method_tail >= 0.45 THEN 'method_opening' WHEN z_tension >= 0.45 THEN 'tension_retained' WHEN tail_shift >= 0.45 THEN 'macro_shift' WHEN branch >= 0.68 THEN 'branch_focus' WHEN problem >= 0.65 AND method >= 0.5 THEN 'problem_exposed'
             WHEN z_mechanism >= 0.4 THEN 'mechanism_named' WHEN z_theme_raise >= 0.48 THEN 'theme_raised' WHEN value >= 0.68 THEN 'judgement_given' WHEN {_has('wz', 'summary')} THEN 'new_pivot' ELSE 'tail_anchor' END AS anchor_focus,
        CASE WHEN problem >= 0.72 AND method >= 0.5 THEN 'countermeasure' WHEN t_mechanism >= 0.6 THEN 'deepen_mechanism' WHEN t_theme_raise >= 0.6 THEN 'subtopic_expand' WHEN value >= 0.68 THEN 'reason_argument' WHEN case_macro_shift_strength >= 0.6 THEN 'macro_unfold'
             WHEN branch >= 0.68 THEN 'focus_branch' WHEN t_tension >= 0.6 THEN 'resolve_tension' WHEN method >= 0.68 THEN 'method_expand' WHEN z_tail_extension >= 0.7 THEN 'explain' ELSE 'deepen_pivot' END AS continuation_type,
        CASE WHEN z_tension >= 0.48 THEN 'tension_hold' WHEN {_has('wz', 'summary')} AND z_tail_extension >= 0.45 THEN 'summary_plus_open' WHEN value >= 0.68 THEN 'judgement_trigger' WHEN z_turning >= 0.4 OR z_next_step >= 0.4 THEN 'transition_trigger'
             ELSE 'open_only' END AS ending_function,
        CASE WHEN t_parallel >= 0.48 THEN 'parallel_expansion' WHEN problem >= 0.62 AND method >= 0.48 THEN 'problem_solution_blocks' WHEN t_chain >= 0.42 THEN 'cause_effect_chain' WHEN local_binding_strength >= 0.58 THEN 'local_binding'
             ELSE 'mixed_layers' END AS middle_structure_type
    FROM f1)"""
THIRD = f"""f3 AS (SELECT *, {_r4('(reference_dependency + backward_link_strength + forward_link_strength) / 3')} AS multi_constraint_density, {_r4('(backward_link_strength + forward_link_strength) / 2')} AS bidirectional_validation,
        {_r4('0.28::DOUBLE * opening_signal_strength + 0.24::DOUBLE * closing_signal_strength + 0.24::DOUBLE * local_binding_strength + 0.24::DOUBLE * (1 - non_opening_penalty)')} AS sequence_integrity,
        CASE candidate_type WHEN 'insertion_context_unit' THEN {_r4('0.4::DOUBLE * reference_dependency + 0.3::DOUBLE * backward_link_strength + 0.3::DOUBLE * forward_link_strength')} ELSE 0.18::DOUBLE END AS insertion_fit_strength,
        CASE WHEN ns = 0 THEN 0 ELSE {_r4('0.24::DOUBLE * least(1::DOUBLE, 0.6::DOUBLE * a_action + 0.4::DOUBLE * a_support) + 0.26::DOUBLE * benefit_result_count + 0.2::DOUBLE * t_benefit + 0.16::DOUBLE * (0.55::DOUBLE * summary + 0.45::DOUBLE * e_closing) + 0.14::DOUBLE * (0.55::DOUBLE * value + 0.45::DOUBLE * e_weight) - 0.12::DOUBLE * greatest(0, turning_focus_strength - 0.62::DOUBLE) - 0.1::DOUBLE * greatest(0, problem - 0.66::DOUBLE) - 0.08::DOUBLE * greatest(0, parallel_enumeration_strength - 0.72::DOUBLE)')} END AS benefit_result_strength,
        CASE continuation_type WHEN 'countermeasure' THEN 'problem_to_solution' WHEN 'deepen_mechanism' THEN 'object_to_mechanism' WHEN 'subtopic_expand' THEN 'theme_to_subtopic' WHEN 'deepen_pivot' THEN 'summary_to_new_pivot' WHEN 'reason_argument' THEN 'judgement_to_reason'
             WHEN 'macro_unfold' THEN 'case_to_macro' WHEN 'focus_branch' THEN 'multi_branch_to_focus' WHEN 'resolve_tension' THEN 'tension_to_explanation' WHEN 'method_expand' THEN 'analysis_to_method' ELSE 'one_level_down' END AS progression_mode,
        list_filter([CASE WHEN turning_focus_strength >= 0.5 THEN 'turn' END, CASE WHEN cause_effect_strength >= 0.5 THEN 'cause' END, CASE WHEN t_necessary >= 0.5 THEN 'condition' END, CASE WHEN parallel_enumeration_strength >= 0.5 THEN 'parallel' END], lambda x: x IS NOT NULL) AS logic_relations
    FROM f2), f4 AS (SELECT *,
        CASE {_pair({'opening/summary': 'summary', 'opening/topic_intro': 'topic_intro', 'middle/carry_previous': 'carry_previous', 'middle/lead_next': 'lead_next', 'middle/bridge': 'bridge', 'ending/conclusion': 'conclusion', 'ending/countermeasure': 'countermeasure'})}
             WHEN candidate_type = 'insertion_context_unit' THEN 'reference_summary' WHEN blank_position = 'opening' AND summary >= 0.58 THEN 'summary' WHEN blank_position = 'ending' THEN 'conclusion' WHEN explanation >= 0.66 THEN 'carry_previous'
             WHEN focus_shift_strength >= 0.62 THEN 'lead_next' ELSE 'bridge' END AS function_type,
        CASE WHEN benefit_result_strength >= 0.66 THEN 'action_to_result' WHEN cause_effect_strength >= 0.52 THEN 'phenomenon_analysis' WHEN turning_focus_strength >= 0.52 THEN 'background_to_point' WHEN parallel_enumeration_strength >= 0.52 THEN 'parallel'
             WHEN value >= 0.62 THEN 'claim_argument' ELSE discourse_shape END AS material_structure_label
    FROM f3), f5 AS (SELECT * REPLACE (coalesce(ss[claims[len(claims)]], tail_anchor) AS ss), genre AS document_genre,
        CASE {_pair({'opening/summary': 'summary', 'opening/topic_intro': 'transition', 'middle/carry_previous': 'explanation', 'middle/lead_next': 'transition', 'middle/bridge': 'continuation', 'ending/conclusion': 'summary', 'ending/countermeasure': 'action'})}
             WHEN function_type = 'countermeasure' THEN 'action' WHEN function_type = 'conclusion' AND elevation_space_strength >= 0.62 THEN 'elevation' WHEN function_type IN ('summary', 'conclusion') THEN 'summary' WHEN function_type = 'carry_previous' THEN 'explanation'
             WHEN function_type = 'lead_next' THEN 'focus_shift' WHEN function_type = 'reference_summary' THEN 'reference_match' WHEN multi_constraint_density >= 0.7 THEN 'multi_constraint' WHEN t_connector >= 0.45 OR turning_focus_strength >= 0.45 THEN 'transition'
             ELSE 'continuation' END AS logic_relation
    FROM f4)"""
NAMED_SQL = {
    "single_center_strength": "center", "summary_strength": "summary", "value_judgement_strength": "value", "judgement_signal_strength": "value", "example_to_theme_strength": "example", "problem_signal_strength": "problem",
    "method_signal_strength": "method", "branch_focus_strength": "branch", "direction_uniqueness": "uniqueness", "explanation_need_strength": "explanation", "standalone_readability": "readability", "titleability": "titleability",
    "counterintuitive_strength": "t_counterintuitive", "timeline_strength": "t_timeline", "mechanism_signal_strength": "t_mechanism", "theme_raise_strength": "t_theme_raise", "tension_signal_strength": "t_tension",
    "tail_extension_signal": "z_tail_extension", "connector_signal_strength": "t_connector", "necessary_condition_strength": "t_necessary", "countermeasure_signal_strength": "t_countermeasure", "object_match_strength": "core_object_anchor_strength",
    "topic_consistency_strength": "object_scope_stability", "tail_settlement_strength": "closing_signal_strength",
}
_SIGNALS_SQL = f"WITH {OBSERVED}, {FIRST}, {SECOND}, {THIRD}"
_NAMED = ", ".join(f"round({b} + 1e-9::DOUBLE, 4) AS {a}" for a, b in NAMED_SQL.items())
NEUTRAL_SQL = f"{_SIGNALS_SQL} SELECT span_id, lang, " + ", ".join([*("ss AS global_main_claim" if x == "global_main_claim" else x for x in neutral.LABELS), *neutral.NUMBERS, _NAMED]) + " FROM f5"


def text_candidates(spark, sf_dir: str) -> DataFrame:
    """Documents as candidates for rule sets: id, article_id (their source), sizes and all signals of their texts."""
    out = neutral.signals(given_spans(spark, sf_dir))
    sizes = {"id": F.col("span_id"), "n_paragraphs": F.col("p"), "own_paragraphs": F.col("p"), "n_sentences": F.col("s"), "n_chars": F.col("n")}
    return out.withColumns(sizes)


#: The same candidates in SQL.
TEXT_CANDIDATES = f"({_SIGNALS_SQL} SELECT span_id AS id, source AS article_id, candidate_type, p AS n_paragraphs, p AS own_paragraphs, s AS n_sentences, n AS n_chars, {', '.join(neutral.NUMBERS)}, {_NAMED} FROM f5 JOIN (SELECT doc_id AS span_id, source FROM documents) USING (span_id))"
_SHOWN = ("global_main_claim", "tail_anchor")


@query(
    f"SELECT * REPLACE (array_to_string(theme_words, ',') AS theme_words, array_to_string(logic_relations, ',') AS logic_relations, md5(global_main_claim) AS global_main_claim, md5(tail_anchor) AS tail_anchor) FROM ({NEUTRAL_SQL})"
)
def neutral_signals(spark, sf_dir):
    """All signals of every document; sentences are shown as digests, lists joined by commas."""
    out = neutral.neutral_signals(given_spans(spark, sf_dir))
    return out.withColumns({**{c: F.md5(c) for c in _SHOWN}, "theme_words": F.array_join("theme_words", ","), "logic_relations": F.array_join("logic_relations", ",")})


@query()
def order_signals(spark, sf_dir):
    """Roles, openers, bonds and risks of every document's units; a test holds them against plain Python."""
    out = orders.order_signals(given_spans(spark, sf_dir))
    return out.withColumn("roles", F.array_join("roles", ","))

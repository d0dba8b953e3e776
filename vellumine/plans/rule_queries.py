"""Queries over the rule sets of ``operators.scoring``, with their SQL.

Main ideas and whole passages are scored by the signals of documents' texts.  The candidates of other
queries are orders.  Their signals are uniform numbers in [0, 1] drawn from hashes of the
order's key, so that every rule meets values on both sides of its thresholds; counts, flags
and kinds are drawn from signals too.  A rule set is data that both engines evaluate, and tests
hold the rule sets against plain Python besides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranking, rules, scoring
from ..operators.rules import Layer
from .catalogue import ORACLES, QUERIES, query, t
from .neutral_queries import TEXT_CANDIDATES, text_candidates

#: Signals that one MD5 hash gives.
PER_HASH = 8


def hashed_signals(rows: DataFrame, names: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` with signals in [0, 1] drawn from hashes of the key."""
    blocks = {f"__x_{b}": F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{b}"))) for b in range(-(-len(names) // PER_HASH))}

    def signal(i: int) -> Column:
        digits = F.substring(f"__x_{i // PER_HASH}", 4 * (i % PER_HASH) + 1, 4)
        return F.conv(digits, 16, 10).cast("double") / 65535.0

    return rows.withColumns(blocks).withColumns({n: signal(i) for i, n in enumerate(names)}).drop(*blocks)


def sql_signals(source: str, names: Sequence[str], key: str = "id") -> str:
    blocks = ", ".join(f"md5({key} || ':{b}') AS x{b}" for b in range(-(-len(names) // PER_HASH)))
    signals = ", ".join(f"('0x' || substr(x{i // PER_HASH}, {4 * (i % PER_HASH) + 1}, 4))::INT::DOUBLE / 65535.0::DOUBLE AS {n}" for i, n in enumerate(names))
    return f"(SELECT * EXCLUDE ({', '.join(f'x{b}' for b in range(-(-len(names) // PER_HASH)))}), {signals} FROM (SELECT *, {blocks} FROM {source}))"


def sql_layers(source: str, layers: Sequence[Layer]) -> str:
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in layer.items())} FROM {source})"
    return source


def pick(signal: str, values: Sequence[str]) -> str:
    """One of several words by a signal."""
    return rules.first([(f"{signal} < {rules.number((i + 1) / len(values))}", f"'{v}'") for i, v in enumerate(values[:-1])], f"'{values[-1]}'")


def count(signal: str, most: int, least: int = 0) -> str:
    """A whole number from least to most by a signal."""
    return f"CAST(floor({signal} * {rules.number((most - least + 1) * 0.999999)}) AS INT) + {least}"


def candidates(spark, sf_dir: str, signals: Sequence[str], layers: Sequence[Layer]) -> DataFrame:
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("article_id"))
    return rules.apply(hashed_signals(orders, signals), layers)


def ruled(name: str, doc: str, signals: Sequence[str], inputs: Layer, layers: Sequence[Layer], out: Sequence[str]) -> None:
    """Register a query that draws inputs, applies a rule set and shows columns of it."""
    drawn = list(dict.fromkeys([*signals, *(f"u{i}" for i in range(12))]))
    whole = [inputs, *layers]

    def run(spark, sf_dir):
        return candidates(spark, sf_dir, drawn, whole).selectExpr("id", *out)

    run.__name__, run.__doc__ = name, doc
    source = "(SELECT o_orderkey AS id, o_custkey AS article_id FROM orders)"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT id, {', '.join(out)} FROM {sql_layers(sql_signals(source, drawn), whole)}"


KIND = {"candidate_type": pick("u0", scoring.CANDIDATE_TYPES)}
SIZES = {"n_paragraphs": count("u1", 26, 1), "own_paragraphs": count("u2", 5, 1), "n_sentences": count("u3", 14, 1), "n_chars": count("u4", 1800, 20)}

_MAIN_OUT = ["candidate_type", "eligibility", "mi_center", "mi_closure", "mi_lift", "mi_example", "main_idea_readiness", "main_idea_final", "main_idea_recommended", "main_idea_needs_review", "main_idea_band", "main_idea_note"]
_MAIN_LAYERS = [*scoring.ELIGIBILITY, *scoring.MAIN_TASK]


@query(f"SELECT id, {', '.join(_MAIN_OUT)} FROM {sql_layers(TEXT_CANDIDATES, _MAIN_LAYERS)}")
def main_idea_scoring(spark, sf_dir):
    """Eligibility, task score, recommendation and difficulty of main-idea candidates, from the signals of their texts."""
    return rules.apply(text_candidates(spark, sf_dir), _MAIN_LAYERS).select("id", *_MAIN_OUT)


ruled(
    "fill_scoring", "Task score, recommendation and difficulty of slots to fill.", scoring.FILL_SIGNALS,
    {
        **KIND, "function_type": pick("u5", (*scoring.FUNCTIONS, "other")), "blank_value_ready": "u6 < 0.8", "slot_explicit_ready": "u7 < 0.7", "n_sentences": count("u3", 4, 1),
        "n_chars": count("u4", 150, 10), "context_sentences": count("u8", 6),
    },
    scoring.FILL_TASK,
    ["function_type", "blank_value", "slot_dependency_score", "role_confidence", "role_ambiguity", "standalone", "overlong", "fill_readiness", "fill_final", "fill_recommended", "fill_needs_review", "fill_band", "fill_note"],
)
ruled(
    "order_scoring", "Task score, recommendation and difficulty of groups to put in order.", scoring.ORDER_SIGNALS,
    {
        **KIND, "first_held": "u1 < 0.8", "n_first": count("u2", 3, 1), "last_held": "u3 < 0.8", "n_last": count("u4", 3, 1), "n_precedence": count("u5", 3), "n_bindings": count("u6", 3),
        "n_grouped": count("u7", 3), "n_units": count("u8", 7, 5),
    },
    scoring.ORDER_TASK,
    ["first_fit", "last_fit", "pairwise", "binding", "weak_constraint", "over_merge", "order_readiness", "order_final", "order_recommended", "order_needs_review", "order_band", "order_note"],
)
PLAN_INPUTS = {
    **KIND, "n_paragraphs": count("u1", 12), "covered": f"CASE WHEN u2 < 0.1 THEN NULL ELSE {count('u2', 5, 1)} END", "composition": pick("u3", ("adjacent_paragraph_pair", "single_paragraph_window", "other")),
    "blank_position": pick("u4", ("opening", "middle", "ending", "inserted")), "function_type": pick("u5", scoring.FUNCTIONS), "slot_explicit_ready": "u6 < 0.5", "repeated_openings": "u7 < 0.2",
    "heading_like": "u8 < 0.2", "directive_like": "u9 < 0.2", "dependent_opening": "u10 < 0.2", "n_units": count("u11", 7, 5), "n_bindings": count("u7", 4), "planned_by_model": "u9 > 0.7",
}
ruled("plan_scores", "Plan score, threshold and scope bonus of every kind of candidate.", scoring.PLAN_SIGNALS, PLAN_INPUTS, scoring.PLAN, ["candidate_type", "scope_bonus", "plan_score", "planned"])

_PLANNED = ORACLES["plan_scores"].replace("SELECT id, ", "SELECT id, article_id, ", 1)


@query(
    f"""WITH p AS ({_PLANNED}), l AS (SELECT *, row_number() OVER (PARTITION BY article_id, candidate_type ORDER BY plan_score DESC, id) AS place FROM p WHERE planned)
    SELECT id, article_id, candidate_type, plan_score, place::INT AS place FROM l WHERE place <= {rules.by_value('candidate_type', scoring.PLAN_LIMITS, 0)}"""
)
def planned_candidates(spark, sf_dir):
    """The best planned candidates of each article within the limits of their types."""
    drawn = list(dict.fromkeys([*scoring.PLAN_SIGNALS, *(f"u{i}" for i in range(12))]))
    p = candidates(spark, sf_dir, drawn, [PLAN_INPUTS, *scoring.PLAN]).select("id", "article_id", "candidate_type", "plan_score", "planned")
    # planned ones first; filters stand after the window, so that no rule is evaluated twice for them
    place = F.row_number().over(W.partitionBy("article_id", "candidate_type").orderBy(F.desc("planned"), F.desc("plan_score"), "id"))
    p = p.withColumn("place", place)
    return p.where(F.expr(f"planned AND place <= {rules.by_value('candidate_type', scoring.PLAN_LIMITS, 0)}")).drop("planned")


FAMILIES = ("title_selection", "sentence_fill", "sentence_order", "continuation", "center_understanding")
FAMILY = {"family": pick("u1", FAMILIES)}
ruled(
    "candidate_quality", "Quality of a candidate for a family: cards, signals, family adjustments, blended with the task score.", scoring.QUALITY_SIGNALS,
    {
        **KIND, **FAMILY, "n_paragraphs": count("u2", 30, 1), "own_paragraphs": count("u3", 5, 1), "n_chars": count("u4", 1800, 20), "n_units": count("u5", 7, 5), "tail_distance": count("u6", 5),
        "blank_position": pick("u7", ("opening", "middle", "ending", "inserted")), "enumerative_opening": "u8 < 0.2", "heading_like": "u9 < 0.2", "directive_like": "u10 < 0.2",
        "task_recommended": "u11 < 0.4", "task_review": "u11 > 0.7",
    },
    scoring.QUALITY, ["family", "candidate_type", "quality"],
)
READY_INPUTS = {
    **FAMILY, "anchor_role": pick("u2", ("gold_ready_positive", "negative_control", "review_holdout_boundary", "none", "none")), "judge_decision": pick("u3", ("accept", "reject", "none", "none")),
    "n_units": count("u4", 7, 5), "anchored": "u5 < 0.5", "canonical": "u6 < 0.6", "structure_label": pick("u7", ("parallel_progress", "problem_solution", "details_summary")),
}
ruled(
    "readiness_judgments", "Readability, structure and family match blended to readiness; with axes and argument forms for central ideas.", scoring.READY_SIGNALS, READY_INPUTS,
    [*scoring.HINTS, *scoring.READINESS], ["family", "anchor_role", "round(structure + 1e-9, 4) AS structure", "round(family_match + 1e-9, 4) AS family_match", "readiness", "readiness_status"],
)
ruled(
    "center_hints", "The main axis and argument form with the largest scores.", scoring.READY_SIGNALS, READY_INPUTS, scoring.HINTS, ["main_axis", "axis_score", "argument", "argument_score"],
)
STATE_INPUTS = {
    "band": pick("u1", ("easy", "medium", "hard")), "recommended": "u2 < 0.5", "needs_review": "u3 < 0.3", "note": pick("u4", ("difficulty_and_quality_balanced", "hard_but_currently_weak_candidate")),
    **{p: pick_p for p, pick_p in zip(scoring.PREFERENCES, ("2 * u5 - 1", "2 * u6 - 1", "2 * u7 - 1", "2 * u8 - 1", "2 * u9 - 1"), strict=True)},
}
ruled(
    "selection_states", "Selection state, risk, repair advice and reason of a scored candidate.", scoring.BRIDGE_SIGNALS, STATE_INPUTS, scoring.SELECTION,
    ["state", "penalty", "top_penalty", "review_like_risk", "repair_reason", "decision_reason"],
)
ruled(
    "bridge_scores", "Quality, readability, reuse, cooldown, matches and preferences blended to one score.", scoring.BRIDGE_SIGNALS,
    {
        **{k: v for k, v in STATE_INPUTS.items() if k in scoring.PREFERENCES}, "usage_count": count("u0", 6), "topic_match": "u1 < 0.3", "direction_match": "u2 < 0.3", "genre_match": "u3 < 0.3",
        "structure_match": "u4 < 0.3", "explicit_card": "u10 < 0.3", "preferred_genre": "u1 > 0.7", "prefer_reused": "u2 > 0.5", "in_cooldown": "u3 > 0.8", "card_exact": "u4 > 0.8", "card_recommended": "u4 > 0.6",
        "expected_units": count("u11", 6), "n_units": count("u10", 6),
    },
    scoring.BRIDGE, ["bridge_score"],
)
ruled(
    "runtime_gates", "The technical floor, the contract and the runtime gate, each with its first reason.", [*scoring.BRIDGE_SIGNALS, "card_score", "business_score"],
    {
        **FAMILY, "candidate_id": "CASE WHEN u2 < 0.02 THEN NULL ELSE CAST(id AS STRING) END", "paragraph_ends": "CASE WHEN u3 < 0.03 THEN NULL ELSE 2 END", "sentence_ends": "CASE WHEN u3 > 0.97 THEN 1 ELSE 2 END",
        "text": "CASE WHEN u4 < 0.03 THEN ' ' WHEN u4 < 0.06 THEN 'a <div class=x>b' WHEN u4 < 0.09 THEN concat('a', chr(7)) ELSE 'plain text' END", "n_units": count("u5", 8, 5),
        "min_final": "CASE WHEN u6 < 0.5 THEN 0.2e0 END", "min_readiness": "CASE WHEN u6 > 0.4 THEN 0.25e0 END", "max_penalty": "CASE WHEN u7 < 0.7 THEN 2.2e0 END", "band": pick("u8", ("easy", "medium", "hard")),
        "min_depth": "0.1e0", "max_ambiguity": "CASE WHEN u9 < 0.5 THEN 0.9e0 END", "min_complexity": "0.1e0", "min_constraint": "CASE WHEN u9 > 0.5 THEN 0.15e0 END", "max_role_ambiguity": "0.9e0", "max_standalone": "CASE WHEN u10 < 0.5 THEN 0.8e0 END",
        "judge_mode": pick("u10", ("off", "shadow", "enforce")), "judge_accepts": "u11 < 0.5", "readiness_status": pick("u11", ("ready", "borderline", "weak", "blocked")), "min_card_score": "0.3e0", "min_business_score": "0.2e0",
        "needs_business_card": "u2 > 0.5",
    },
    [
        {"band_forbidden": "band = 'easy' AND u7 > 0.8", "judged_family": scoring.one_of("family", ("center_understanding", "sentence_fill", "sentence_order")), "has_markup": "lower(text) LIKE '%<div%>%'", "has_controls": "text LIKE concat('%', chr(7), '%')"},
        {"technical": scoring.TECHNICAL.replace("coalesce(article_id, '') = ''", "article_id IS NULL"), "contract": scoring.CONTRACT},
        {"runtime": scoring.RUNTIME},
    ],
    ["family", "technical", "contract", "runtime"],
)
ruled(
    "structure_matches", "How far a fill or order candidate has the structure that is asked for.", [*scoring.ORDER_SIGNALS, "temporal_strength", "action_strength"],
    {
        **FAMILY, "blank_position": pick("u2", ("opening", "middle", "ending")), "asked_position": f"CASE WHEN u3 < 0.8 THEN {pick('u3', ('opening', 'middle', 'ending'))} END", "keep_position": "u4 < 0.5",
        "function_type": pick("u5", scoring.FUNCTIONS), "asked_function": f"CASE WHEN u6 < 0.8 THEN {pick('u5', scoring.FUNCTIONS[::-1])} END", "n_units": count("u7", 9, 3),
        "asked_units": f"CASE WHEN u8 < 0.8 THEN {count('u8', 9, 3)} END", "keep_units": "u9 < 0.5", "shared_modes": count("u10", 4), "shared_bindings": count("u11", 3), "n_bindings": count("u2", 4),
        "asked_bindings": f"CASE WHEN u3 < 0.8 THEN {count('u4', 4, 1)} END", "progression_met": "u5 < 0.4", "asked_sequence": "u6 < 0.5", "asked_uniqueness": "CASE WHEN u9 < 0.7 THEN u9 END",
    },
    [{"uniqueness": scoring.UNIQUENESS}, {"structure_match": scoring.STRUCTURE_MATCH}], ["family", "structure_match"],
)
ruled(
    "external_acceptance", "Candidates from outside: accepted, for review or neither.", ["task_final", "structure_match", "quality_score", "query_match", "context_dependency", "branch_focus_strength"], {"n": "1"},
    scoring.EXTERNAL, ["outside_readiness", "outside_final", "outside_recommended", "outside_review"],
)
_AFFINITIES = {f"near_{k}": rules.mean(*v) for k, v in scoring.AFFINITY.items()}
_ORDERED = [f"CASE WHEN place_{k} = {{n}} THEN concat('{k}:', CAST(near_{k} AS DECIMAL(5, 4))) END" for k in scoring.AFFINITY]


def _place(name: str) -> str:
    """1 + the number of families that are nearer, or as near and listed before."""
    names = list(scoring.AFFINITY)
    ahead = [f"CASE WHEN near_{k} {'>=' if names.index(k) < names.index(name) else '>'} near_{name} THEN 1 ELSE 0 END" for k in names if k != name]
    return " + ".join(["1", *ahead])


ruled(
    "family_affinity", "The three families that a candidate's signals are nearest to.", sorted({x for v in scoring.AFFINITY.values() for x in v}), {"n": "1"},
    [_AFFINITIES, {f"place_{k}": _place(k) for k in scoring.AFFINITY}, {"nearest": "concat_ws(',', " + ", ".join(f"coalesce({', '.join(x.format(n=n) for x in _ORDERED)})" for n in (1, 2, 3)) + ")"}], ["nearest"],
)
ruled(
    "quality_flags", "Flags of a material that a reviewer should see.", ["f1", "f2", "independence", "continuation_openness", "direction_uniqueness"], {"best_family_score": "greatest(f1, f2)", "channel": pick("u1", ("gray", "stable"))},
    [{"flags": scoring.FLAGS}], ["flags"],
)

_WHOLE_LAYERS = [{"centre": "single_center_strength", "parallel_strength": "parallel_enumeration_strength", "article_chars": "n_chars"}]
#: From which strength of its centre on a candidate is focused.
_FOCUSED = 0.78


@query(
    f"SELECT id, article_id, focused, {scoring.WHOLE_PASSAGE} AS gate FROM (SELECT *, max(CASE WHEN candidate_type <> 'whole_passage' AND centre >= {_FOCUSED} THEN 1 ELSE 0 END) OVER (PARTITION BY article_id) = 1 AS focused "
    f"FROM {sql_layers(TEXT_CANDIDATES, _WHOLE_LAYERS)}) WHERE candidate_type = 'whole_passage'"
)
def whole_passage_gate(spark, sf_dir):
    """Whole passages must be narrow, closed and focused; an article's focused candidates raise the bar.

    Whether an article has any is a grouped maximum that is joined back, so no article is gathered.
    """
    c = rules.apply(text_candidates(spark, sf_dir), _WHOLE_LAYERS)
    kept = [x for x in ("id", "article_id", "candidate_type", "centre", *scoring.WHOLE_SIGNALS, "own_paragraphs", "n_paragraphs", "n_sentences", "n_chars", "article_chars")]
    c = c.select(*dict.fromkeys(kept))
    focus = c.where(f"candidate_type <> 'whole_passage' and centre >= {_FOCUSED}").select("article_id").distinct().withColumn("focused", F.lit(True))
    whole = c.where("candidate_type = 'whole_passage'").join(focus, "article_id", "left").withColumn("focused", F.coalesce("focused", F.lit(False)))
    return whole.select("id", "article_id", "focused", F.expr(scoring.WHOLE_PASSAGE).alias("gate"))


ruled(
    "order_uniqueness", "How surely the units of a group have one order only.", scoring.UNIQUE_SIGNALS, {"n_pairs": count("u0", 6), "has_closing": "u1 < 0.5"}, scoring.UNIQUENESS_PROFILE,
    ["opener", "overlap", "closure", "exchange", "multi_path", "unique_answer"],
)

#: id: relation, preferred markers, structural preferences, own weights, hard filter on the relation.
BUSINESS_CARDS = {
    "turn_focus": ("turn", True, {"genre = 'report'": 0.35, "structure_label = 'contrast'": 0.35}, None, True),
    "cause_result": ("cause", True, {"structure_label = 'chain'": 0.35, "conclusion_position = 'tail_or_late'": 0.30}, {"relation": 0.40, "readability": 0.05}, False),
    "condition_need": ("condition", False, {"genre = 'essay'": 0.35}, None, True),
    "parallel_points": ("parallel", True, {"structure_label = 'list'": 0.35, "genre = 'report'": 0.35, "conclusion_position = 'opening'": 0.30}, None, False),
    "theme_word": ("theme", False, {}, None, False),
}
_CARD_INPUTS = {
    **{f"has_{k}": f"u{i} < 0.25" for i, k in enumerate(scoring.RELATION_SIGNALS)}, "n_turn": count("u4", 2), "n_cause": count("u5", 2), "n_conclusion": count("u6", 2), "n_condition": count("u7", 2), "n_counter": count("u8", 2),
    "n_parallel": count("u9", 3), "conclusion_position": pick("u10", ("tail_or_late", "middle", "opening", "none")), "genre": pick("u11", ("report", "essay")), "structure_label": pick("u4", ("contrast", "chain", "list")),
}
_CARD_SCORES = {f"s_{k}": scoring.business_score(*card) for k, card in BUSINESS_CARDS.items()}
_CARD_DRAWN = [*scoring.BUSINESS_SIGNALS, *(f"u{i}" for i in range(12))]
_CARD_LEAST, _CARD_TOP = 0.45, 3


@query(
    f"WITH s AS (SELECT * FROM {sql_layers(sql_signals('(SELECT o_orderkey AS id, o_custkey AS article_id FROM orders)', _CARD_DRAWN), [_CARD_INPUTS, _CARD_SCORES])}), c AS ("
    + " UNION ALL ".join(f"SELECT id, '{k}' AS card, {i} AS place, s_{k} AS score FROM s" for i, k in enumerate(BUSINESS_CARDS))
    + f") SELECT id, card, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, place)::INT AS rank FROM c WHERE score >= {_CARD_LEAST} QUALIFY rank <= {_CARD_TOP}"
)
def business_cards(spark, sf_dir):
    """The best business cards of each candidate; all cards of a candidate stay in its row, so nothing is shuffled."""
    c = candidates(spark, sf_dir, _CARD_DRAWN, [_CARD_INPUTS, _CARD_SCORES])
    entries = F.array(*(F.when(F.col(f"s_{k}") >= _CARD_LEAST, F.struct((-F.col(f"s_{k}")).alias("by"), F.lit(i).alias("place"), F.lit(k).alias("card"))) for i, k in enumerate(BUSINESS_CARDS)))
    best = F.slice(F.array_sort(F.array_compact(entries)), 1, _CARD_TOP)
    return c.select("id", F.posexplode(best).alias("i", "b")).select("id", "b.card", (-F.col("b.by")).alias("score"), (F.col("i") + 1).alias("rank"))

_RANK_DRAWN = [*ranking.SIGNALS, *(f"u{i}" for i in range(8))]
_RANK_INPUTS = {
    **FAMILY, "query": "article_id % 3", "candidate_type": pick("u0", ("whole_passage", "multi_paragraph_unit", "closed_span", "functional_slot_unit", "sentence_block_group")), "blank_position": pick("u2", ("opening", "inserted", "middle", "ending")),
    "covered": "u3 < 0.3", "function_type": pick("u4", ("topic_intro", "summary", "bridge", "reference_summary")), "structure_kind": pick("u5", ("leading", "loose", "other")), "width": count("u6", 4, 1),
    "anchor_role": pick("u7", ("review_holdout_boundary", "none")),
}
RANKED = 60


@query(
    f"WITH k AS (SELECT * FROM {sql_layers(sql_signals('(SELECT o_orderkey AS id, o_custkey AS article_id FROM orders)', _RANK_DRAWN), [_RANK_INPUTS, *ranking.SORT])}) SELECT query, family, id, k1, k2, "
    f"row_number() OVER (PARTITION BY query, family ORDER BY {', '.join(f'{k} DESC' for k in ranking.KEYS)}, id)::INT AS place FROM k QUALIFY place <= {RANKED}"
)
def family_ranking(spark, sf_dir):
    """The sixty best candidates of each query and family: a top-k report."""
    return ranking.ranked(candidates(spark, sf_dir, _RANK_DRAWN, [_RANK_INPUTS]), "query", RANKED).select("query", "family", "id", "k1", "k2", "place")


@query()
def guarded_ranking(spark, sf_dir):
    """One pass of swaps, each after those before; a test holds the query against plain Python."""
    best = ranking.ranked(candidates(spark, sf_dir, _RANK_DRAWN, [_RANK_INPUTS]), "query", RANKED)
    return ranking.guarded(best, "query")

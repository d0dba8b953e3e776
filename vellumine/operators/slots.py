"""Slots to be filled: sentences at the opening, in the middle and at the end of an article, and what gates say of them.

The first sentence of an article, the first two of each later paragraph, and the last of the last
one are looked at.  A slot is judged by its own sentence and by the paragraphs on either side, of
which only the first and last sentences count (before an ending, also the whole paragraph).  All of
that stands in the article's row; what is shuffled are the middle slots that passed, of which an
article keeps the best.

Links to the left and right, as numbers, are weighed into a trace; a trace gives a middle slot its
role (carrying on, bridging, leading on).  The gates are ordered decisions over counts and traces.

Articles are (article_id, lang, text) with distinct identifiers.  Edge cases: null and empty texts have
no slots; an article of one sentence has an opening and an ending that are the same sentence;
languages without a pack have no markers; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from . import neutral, rules
from .rules import first, reason, rounded, score, weighted

#: Most characters of a slot, and middle slots of an article.
MOST_CHARS, MOST_MIDDLE = 160, 2
#: Priorities by position; a middle slot's grows with its links and falls with its place in the paragraph.
# Fixed values.
PRIORITY = {"opening": 0.82, "middle": 0.74, "ending": 0.80}
BY_LINKS, BY_PLACE = 0.10, 0.03
#: Sentences of a paragraph that are looked at: the first two and the last.
LOOKED_AT = 3


def candidates(articles: DataFrame) -> DataFrame:
    """(article_id, lang, position, paragraph, place, sentence, n_paragraphs, text, own, before_head, before_tail, after_tail, before): all sentences that may be slots.

    ``place`` counts in the paragraph and ``sentence`` in the article, from 0.  ``own``, ``before_head``, ``after_tail`` and ``before`` (the paragraph before an
    ending) are what ``markers.scan`` found; each sentence is scanned once, however many slots look at it.  ``before_tail`` is a text.
    """
    body, lang = T.clean(F.coalesce("text", F.lit(""))), F.col("lang")
    cut = articles.select("article_id", "lang", T.paragraphs(body, lang).alias("paras"))
    cut = cut.withColumn("cuts", F.transform("paras", lambda p: T.sentences(p, lang)))
    n = F.size("cuts")
    text = lambda s, place: F.coalesce(F.get(s, place), F.lit(""))
    looked = F.transform("cuts", lambda s: F.array(text(s, F.lit(0)), text(s, F.lit(1)), F.when(F.size(s) >= LOOKED_AT, F.get(s, F.size(s) - 1)).otherwise("")))
    seen = F.concat(F.flatten(looked), F.array(text(F.col("paras"), n - 2)))
    cut = cut.withColumns({"offsets": T.sums_before(F.transform("cuts", lambda s: F.size(s))), "x": M.scan(seen, lang, results=False)})

    def of(s: Column, i: Column) -> Column:
        left, right, last = F.get("cuts", i - 1), F.get("cuts", i + 1), F.size(s) - 1
        ends = lambda s: F.least(F.size(s), F.lit(LOOKED_AT)) - 1
        found = lambda i, k: F.get("x", i * LOOKED_AT + k)

        def slot(position: str, place: Column, k: Column) -> Column:
            return F.struct(
                F.lit(position).alias("position"), i.alias("paragraph"), place.alias("place"), (F.get("offsets", i) + place).alias("sentence"), n.alias("n_paragraphs"), F.get(s, place).alias("text"),
                found(i, k).alias("own"), F.when(left.isNotNull(), found(i - 1, F.lit(0))).alias("before_head"), F.get(left, F.size(left) - 1).alias("before_tail"),
                F.when(right.isNotNull(), found(i + 1, ends(right))).alias("after_tail"), F.when(left.isNotNull() & F.lit(position == "ending"), F.get("x", F.size("x") - 1)).alias("before"),
            )

        slots = [
            F.when(i == 0, slot("opening", F.lit(0), F.lit(0))), F.when(i > 0, slot("middle", F.lit(0), F.lit(0))), F.when((i > 0) & (last > 0), slot("middle", F.lit(1), F.lit(1))),
            F.when(i == n - 1, slot("ending", last, ends(s))),
        ]
        return F.array_compact(F.array(*slots))

    return cut.select("article_id", "lang", F.explode(F.flatten(F.transform("cuts", of))).alias("s")).select("article_id", "lang", "s.*")


#: Groups whose strength, occurrence and number of different markers in a slot's sentence are read.
STRENGTHS, PRESENT, KINDS = (
    ("closing", "summary", "slot_remedy"),
    tuple(f"slot_{g}" for g in "intro trouble ask raised tail summary reference weak_carry explaining onward bridging listing decorative firm modal".split()) + ("closing",),
    ("action", "slot_policy", "slot_value"),
)


def observed(slots: DataFrame) -> DataFrame:
    """Slots with what stands in their sentence and in those on either side."""
    c = F.col
    out = slots.withColumns({"has_before": c("before_head").isNotNull(), "has_after": c("after_tail").isNotNull()})
    own, head, tail = c("own"), F.coalesce("before_head", "own"), F.coalesce("after_tail", "own")
    short = lambda g: g.removeprefix("slot_")
    columns = {f"m_{short(g)}": M.strength(M.count(own["hits"], g)) for g in STRENGTHS}
    columns |= {f"p_{short(g)}": M.has(own["hits"], g) for g in PRESENT} | {f"k_{short(g)}": M.kinds(own["hits"], g) for g in KINDS}
    columns |= {f"s_{short(g)}": M.starts(own["start"], g) for g in ("slot_new_layer", "slot_onward_start", "context")}
    columns |= {
        "pressed": F.coalesce(M.has(c("before")["hits"], "slot_pressure"), F.lit(False)), "head_context": M.starts(head["start"], "context"), "r_head": M.count(head["hits"], "reference"), "r_own": M.count(own["hits"], "reference"),
        "m_tail_extension": M.strength(M.count(tail["hits"], "tail_extension")), "p_forward": M.has(tail["hits"], "forward"), "n": F.length("text"), "n_plain": F.length("text") - F.regexp_count("text", F.lit(r"\s")),
        "n_digits": F.regexp_count("text", F.lit(r"\p{Nd}|[%％]")), "n_commas": F.regexp_count("text", F.lit("[，,]")), "n_marks": F.regexp_count("text", F.lit("[，,、]")), "n_quotes": F.regexp_count("text", F.lit('[“”"]')),
        "n_core": F.length("text") - F.regexp_count("text", F.lit(r"[，。；、,;!?！？\s]")), "asks": c("text").rlike(r"[？?]\s*$"),
    }
    out = out.withColumns(columns).withColumns({x: c(x)["text"] for x in ("before_head", "after_tail", "before")}).drop("own")
    for name in ("text", "before_tail"):
        out = out.withColumn("o", neutral.objects(F.coalesce(c(name), F.lit("")), c("lang")))
        out = neutral.tallied(out, f"c_{name}", c("o")).withColumn(f"n_{name}", F.size("o")).drop("o")
    words = lambda counts: F.transform(F.slice(counts, 1, 5), lambda x: x["word"])
    mine, theirs = words("c_text"), words("c_before_tail")
    shared = F.size(F.array_intersect(mine, theirs))
    out = out.withColumns(
        {"anchor": neutral._anchor("c_text", "n_text"), "overlap": F.when((F.size(mine) > 0) & (F.size(theirs) > 0), shared / F.least(F.size(mine), F.size(theirs))).otherwise(0.0)}
    )
    return out.drop("c_text", "c_before_tail", "n_text", "n_before_tail")


def _capped(weights, bonuses, base: str = "", after: str = "") -> str:
    return f"least(1e0, {base + ' + ' if base else ''}{weighted(weights, bonuses)}{after})"


_REFERENCE = "r_{0} * 0.18e0 + CASE WHEN r_{0} > 0 THEN 0.22e0 ELSE 0e0 END"
_BACK = "CASE WHEN {0} THEN 0.78e0 WHEN " + rounded(rules.unit(_REFERENCE)).replace("{0}", "{1}") + " >= 0.45 THEN 0.62e0 ELSE 0.42e0 END"
_DENSE = "(n_digits / CAST(greatest(1, {0}) AS DOUBLE))"
_TAIL_LIKE = "({before} AND (marked OR ({back} >= 0.40 AND (k_policy >= 1 OR k_value >= 1))))"

# Weights, thresholds, reasons.
TRACE: list[rules.Layer] = [
    {
        "back": _BACK.format("head_context", "head"),
        "own_back": _BACK.format("s_context", "own"),
        "ahead": score({"m_tail_extension": 0.40}, {"p_forward": 0.15}, 0.35),
        "reference_dependency": rounded(rules.unit(_REFERENCE.format("own"))),
        "decorative": "p_decorative OR (n_core <= 14 AND NOT p_firm)",
        "marked": "m_closing >= 0.16 OR p_tail",
        "topic_continuity": "least(1e0, 0.58e0 * overlap + CASE WHEN overlap > 0 THEN 0.18e0 ELSE 0e0 END + CASE WHEN p_reference OR p_weak_carry THEN 0.12e0 ELSE 0e0 END)",
        "layer_continuity": _capped({}, {"has_before": 0.24, "NOT p_onward": 0.18, "NOT p_bridging": 0.14, "NOT p_closing": 0.14, "NOT s_new_layer": 0.12}),
    },
    {
        "both": rules.mean("back", "ahead"),
        "backward": _capped({"back": 1.0}, {"p_reference": 0.18, "p_weak_carry": 0.10, "p_explaining": 0.14, "p_bridging": 0.08, "s_context": 0.08}),
        "forward": _capped({"ahead": 1.0}, {"p_onward": 0.18, "p_bridging": 0.16, "s_onward_start": 0.10}),
    },
    {
        "bidirectional": _capped({"both": 1.0}, {"p_bridging": 0.20, "p_reference AND p_onward": 0.12, "least(back, ahead) >= 0.46": 0.08}),
        "carry_dependency": _capped(
            {"backward": 0.45, "reference_dependency": 0.20}, {"p_reference": 0.15, "p_weak_carry": 0.08, "p_explaining": 0.12, "has_before": 0.08}, after=" - 0.18e0 * anchor"
        ),
        "carry_gap": _capped(
            {"backward": 0.34, "topic_continuity": 0.24, "layer_continuity": 0.18}, {"p_weak_carry": 0.10, "has_before": 0.08},
            after=" - 0.1e0 * anchor - CASE WHEN p_onward THEN 0.1e0 ELSE 0e0 END - CASE WHEN p_bridging THEN 0.1e0 ELSE 0e0 END",
        ),
        "forward_dependency": _capped({"forward": 0.50}, {"p_onward": 0.14, "has_after": 0.08, "NOT p_reference": 0.06, "p_explaining": -0.08}),
    },
    {
        "bridge_dependency": _capped(
            {"backward": 0.28, "forward": 0.28, "bidirectional": 0.24}, {"p_bridging": 0.14, "p_reference AND p_onward": 0.08, "has_before AND has_after": 0.08}, after=" - 0.1e0 * anchor"
        ),
        "carry_ready": "carry_gap >= 0.40 AND backward >= 0.54 AND carry_dependency >= 0.48 AND forward_dependency <= greatest(0.38e0, carry_gap - 0.02e0) AND anchor <= 0.72",
    },
]
#: Roles of a middle slot with the reason, by the first condition that holds.
ROLES = (
    ("bridge", "middle_bridge_marker", "p_bridging AND bidirectional >= 0.50 AND backward >= 0.40 AND forward >= 0.40 AND bridge_dependency >= 0.58"),
    ("bridge", "middle_bridge_bidirectional", "bidirectional >= 0.58 AND backward >= 0.44 AND forward >= 0.44 AND bridge_dependency >= 0.60"),
    ("carry_previous", "middle_carry_previous_backward", "carry_ready AND backward >= 0.56 AND forward <= backward - 0.08e0 AND carry_dependency >= 0.56"),
    ("lead_next", "middle_lead_next_forward", "forward >= 0.54 AND backward <= forward - 0.04e0 AND forward_dependency >= 0.52"),
    ("carry_previous", "middle_carry_previous_reference", "carry_ready AND backward >= 0.52 AND forward < 0.44 AND carry_dependency >= 0.54"),
    (
        "carry_previous", "middle_carry_previous_weak_explicit",
        "carry_ready AND backward >= 0.56 AND forward <= 0.38 AND carry_dependency >= 0.48 AND layer_continuity >= 0.78 AND (p_reference OR p_weak_carry) AND NOT p_bridging AND forward_dependency <= 0.36",
    ),
    (
        "carry_previous", "middle_carry_previous_implicit",
        "carry_ready AND backward >= 0.50 AND forward <= backward - 0.04e0 AND topic_continuity >= 0.42 AND layer_continuity >= 0.60 AND carry_gap >= 0.48 AND anchor <= 0.72 AND NOT p_bridging AND NOT p_onward",
    ),
    ("lead_next", "middle_lead_next_transition", "forward >= 0.50 AND backward < 0.50 AND forward_dependency >= 0.50"),
)
#: Numbers of the trace, shown and compared further on to four places.
NUMBERS = (
    "backward forward bidirectional carry_dependency carry_gap bridge_dependency forward_dependency topic_continuity layer_continuity".split()
)
#: A middle slot's gap: what it may be, when, how strongly, and the reason.
GAPS = {
    "carry_previous": (
        "carry_ready AND backward >= 0.64 AND carry_dependency >= 0.66 AND carry_gap >= 0.54 AND forward_dependency BETWEEN 0.16 AND 0.46 AND topic_continuity >= 0.46 AND layer_continuity >= 0.72 AND anchor <= 0.58 "
        "AND (p_reference OR p_weak_carry) AND NOT p_bridging AND n_marks <= 3 AND n <= 76",
        {"backward": 0.32, "carry_dependency": 0.24, "carry_gap": 0.18, "topic_continuity": 0.12, "layer_continuity": 0.14}, "middle_carry_prechecked_gap",
    ),
    "bridge": (
        "bidirectional >= 0.72 AND least(backward, forward) >= 0.58 AND bridge_dependency >= 0.76 AND forward_dependency >= 0.42 AND anchor <= 0.54 AND p_bridging AND (p_reference OR p_onward) AND n_marks <= 3 AND n <= 68",
        {"backward": 0.28, "forward": 0.28, "bidirectional": 0.22, "bridge_dependency": 0.22}, "middle_bridge_prechecked_gap",
    ),
    "lead_next": (
        "forward >= 0.64 AND forward_dependency >= 0.62 AND backward <= 0.48 AND bidirectional <= 0.54 AND anchor <= 0.56 AND p_onward AND n_marks <= 3 AND n <= 64",
        {"forward": 0.42, "forward_dependency": 0.30, "(1 - least(1e0, backward))": 0.28}, "middle_lead_prechecked_gap",
    ),
}
_NONE = "middle_blank_value_gap_not_strong_enough"
#: What a slot at the opening, one that is to carry a countermeasure and one in the middle fail by, in this order.
OPENING_FAILS = (
    ("NOT has_after", "opening_topic_intro_missing_right_context"),
    ("n >= 150 AND NOT p_trouble AND NOT p_ask", "opening_topic_intro_detail_heavy"),
    (f"n_digits > 0 AND {_DENSE.format('n_plain')} >= 0.12 AND n_commas >= 4 AND NOT (p_intro OR p_trouble OR p_ask) AND anchor < 0.34", "opening_topic_intro_data_opening"),
    ("n_commas >= 6 AND NOT (p_trouble OR p_ask) AND m_closing < 0.24", "opening_topic_intro_list_like"),
    ("ahead < 0.40 AND NOT (p_trouble OR p_ask)", "opening_topic_intro_forward_link_weak"),
    ("NOT (p_intro OR p_trouble OR p_ask OR anchor >= 0.28 OR m_closing >= 0.20)", "opening_topic_intro_anchor_weak"),
)
MEASURE_FAILS = (
    ("m_closing >= 0.32 AND k_action = 0", "ending_countermeasure_summary_like"),
    ("p_modal AND k_action = 0 AND NOT {pressed}", "ending_countermeasure_modal_without_action"),
    ("k_policy >= 3 AND k_action = 0 AND NOT {pressed}", "ending_countermeasure_policy_statement"),
    ("m_remedy < 0.16 AND k_action = 0 AND NOT {pressed}", "ending_countermeasure_signal_weak"),
    ("{back} < 0.40", "ending_countermeasure_backward_link_weak"),
    ("k_action = 0 AND NOT {pressed} AND m_remedy < 0.24", "ending_countermeasure_missing_action_target"),
)
MIDDLE_FAILS = (
    ("NOT (has_before AND has_after)", "middle_blank_value_requires_two_side_context"),
    ("decorative", "middle_blank_value_decorative_sentence"),
    (f"{_DENSE.format('n_plain')} >= 0.10 OR ({_DENSE.format('n_plain')} >= 0.06 AND n_marks >= 4)", "middle_blank_value_data_heavy"),
    ("n_marks >= 5 OR p_listing", "middle_blank_value_list_like"),
    ("n >= 88 OR n_quotes >= 2", "middle_blank_value_detail_heavy"),
    ("anchor >= 0.70 AND reference_dependency < 0.22", "middle_blank_value_sentence_too_independent"),
)
OPENING_GOOD, MEASURE_GOOD = "opening_topic_intro_anchor", "ending_countermeasure_anchor"
#: What an opening that passes must have beside that, to introduce a topic.
OPENING_MORE = (
    ("NOT (p_raised OR asks)", "opening_topic_intro_macro_background"),
    ("ahead < 0.48", "opening_topic_intro_forward_gap_not_clear"),
    ("n_commas >= 4 OR n_digits > 0", "opening_topic_intro_surface_only"),
)
#: Endings that are no countermeasure, by the first condition; they conclude where they look back.
ENDING_TURNS = (
    ("p_modal AND k_action = 0", "modal", "modal_without_action"), ("k_policy >= 2 AND k_action <= 1", "policy", "policy_statement"), ("k_value >= 2 AND k_action = 0", "value", "value_judgement"),
    ("{back} < 0.40", "backward", "backward_link_weak"),
)


def _ending(before: str, back: str, measured: str) -> str:
    """Reason of an ending, as an expression; ``measured``: the column of what a countermeasure fails by."""
    like = _TAIL_LIKE.format(before=before, back=back)
    names = {"backward": "conclusion_backward_supported"}
    cases = [(f"marked AND {before} AND (k_action = 0 OR k_policy >= 2 OR k_value >= 2)", "conclusion_reclassified")]
    for where, turned, fails in ENDING_TURNS:
        cases += [(f"{where.format(back=back)} AND {like}", names.get(turned, f"conclusion_{turned}_reclassified")), (where.format(back=back), f"ending_countermeasure_{fails}")]
    cases += [(f"({measured} = '{MEASURE_GOOD}' AND k_action >= 1)", MEASURE_GOOD), (like, "conclusion_fallback_reclassified")]
    return _at("ending", reason(cases, "ending_countermeasure_reject_surface_only"))


def _measure(back: str, pressed: str) -> str:
    return _at("ending", reason([(x.format(pressed=pressed, back=back), r) for x, r in MEASURE_FAILS], MEASURE_GOOD))


def _function(told: str) -> str:
    return reason([(f"{told} LIKE 'conclusion%'", "conclusion"), (f"{told} = '{MEASURE_GOOD}'", "countermeasure")])


def _at(position: str, told: str) -> str:
    """An expression that is only asked of slots there; the others have the empty word."""
    return f"CASE WHEN position = '{position}' THEN {told} ELSE '' END"


def _gap(name: str) -> str:
    return f"CASE WHEN {GAPS[name][0]} THEN {rounded(weighted(GAPS[name][1]))} ELSE -1e0 END"


_OPENING = _at("opening", reason(OPENING_FAILS, OPENING_GOOD))
_SUMMARY_OPENING = "has_after AND m_closing >= 0.16 AND ahead >= 0.42 AND n_commas <= 4 AND NOT (n_digits > 0 AND n_commas >= 3)"
GATES: list[rules.Layer] = [
    {"role": reason([(where, role) for role, _, where in ROLES]), "role_reason": reason([(where, why) for _, why, where in ROLES], "middle_role_unresolved")},
    {x: rounded(x) for x in NUMBERS},
    {f"gap_{name}": _gap(name) for name in GAPS} | {"opening_gate": _OPENING, "measure_gate": _measure("back", "pressed"), "measure_alone": _measure("own_back", "false")},
    {"ending_reason": _ending("has_before", "back", "measure_gate"), "reason_alone": _ending("false", "own_back", "measure_alone")},
    {"ending_function": _function("ending_reason"), "ending_alone": _function("reason_alone")},
    {"gap_best": "greatest(gap_carry_previous, gap_bridge, gap_lead_next)"},
    {
        "gap": reason([*((w, "") for w, _ in MIDDLE_FAILS), ("gap_best < 0", ""), *((f"gap_{name} = gap_best", name) for name in GAPS)]),
        "gap_reason": reason([*MIDDLE_FAILS, ("gap_best < 0", _NONE), *((f"gap_{name} = gap_best", GAPS[name][2]) for name in GAPS)]),
        "opening_reason": _at("opening", reason([(_SUMMARY_OPENING, "summary_reclassified"), *OPENING_FAILS, *OPENING_MORE], OPENING_GOOD)),
    },
    {
        # what the contexts make of it
        "resolved": first(
            [
                ("position = 'opening'", reason([("opening_reason = 'summary_reclassified'", "summary"), (f"opening_reason = '{OPENING_GOOD}'", "topic_intro")])), ("position = 'ending'", "ending_function"),
            ],
            "gap",
        ),
        "resolved_reason": first([("position = 'opening'", "opening_reason"), ("position = 'ending'", "ending_reason")], "gap_reason"),
        # what the sentence alone makes of it
        "function": first([("position = 'opening'", "CASE WHEN p_summary OR m_summary >= 0.50 THEN 'summary' ELSE '' END"), ("position = 'ending'", "ending_alone")], "role"),
    },
    {
        "value_reason": first(
            [
                ("decorative AND greatest(back, ahead, both) < 0.52", "'decorative_sentence_low_gap'"),
                ("position = 'opening' AND function = 'summary'", "CASE WHEN m_closing >= 0.16 AND has_after THEN 'summary_anchor' ELSE 'summary_weak_blank_value' END"), ("position = 'opening'", "opening_gate"),
                ("position = 'middle' AND gap = ''", "gap_reason"), ("position = 'middle' AND gap <> function", "concat('middle_role_mismatch:', gap)"), ("position = 'middle'", "gap_reason"),
                ("function = 'countermeasure'", "measure_gate"), ("marked AND has_before", "'conclusion_anchor'"),
            ],
            "'conclusion_weak_anchor'",
        ),
        "links": rounded("greatest(bidirectional, backward, forward)"),
    },
    {
        "ready": f"n <= {MOST_CHARS} AND (position <> 'middle' OR function <> '') AND (value_reason IN ('summary_anchor', '{OPENING_GOOD}', '{MEASURE_GOOD}', 'conclusion_anchor') OR value_reason LIKE 'middle%prechecked_gap')",
        "priority": "round(" + rules.by_value("position", {k: f"{rules.number(v)} + " + (f"{BY_LINKS}e0 * links - {BY_PLACE}e0 * place" if k == "middle" else "0e0") for k, v in PRIORITY.items()}, 0.0) + " + 1e-9, 4)",
    },
]


def gates(articles: DataFrame) -> DataFrame:
    """Every candidate with its trace, its role, what the contexts make of it, and whether and why it is worth a blank."""
    return rules.apply(observed(candidates(articles)), TRACE + GATES)


def units(articles: DataFrame) -> DataFrame:
    """The slots that are worth a blank, numbered in each article: the opening, the middle ones with the strongest links, the ending.

    ``first_paragraph`` to ``last_paragraph`` and ``first_sentence`` to ``last_sentence`` are the context.
    """
    c = F.col
    slot = F.struct(
        "position", "function", "paragraph", "sentence", "links", "priority", "value_reason", "text", F.greatest(c("paragraph") - 1, F.lit(0)).alias("first_paragraph"),
        F.least(c("paragraph") + 1, c("n_paragraphs") - 1).alias("last_paragraph"), F.greatest(c("sentence") - 1, F.lit(0)).alias("first_sentence"), (c("sentence") + c("has_after").cast("int")).alias("last_sentence"),
    )
    # a condition on ``ready`` would be written out down to the markers below all layers; one on the exploded row stays above them
    out = gates(articles).select("article_id", F.explode_outer(F.array(F.when(c("ready"), slot))).alias("s")).where("s IS NOT NULL").select("article_id", "s.*")
    turn = F.when(c("position") == "opening", 0).when(c("position") == "middle", 1).otherwise(2)
    best = out.withColumn("turn", turn).withColumn("rank", F.row_number().over(Window.partitionBy("article_id", "turn").orderBy(c("links").desc(), "sentence"))).where((c("turn") != 1) | (c("rank") <= MOST_MIDDLE))
    return best.withColumn("number", F.row_number().over(Window.partitionBy("article_id").orderBy("turn", "rank")).cast("long")).drop("turn", "rank", "links")

"""Subtypes of families, when a model would be asked, and the governance of labels.

Subtype rules are rows (family, subtype, condition, score).  All of a span's labels stay in
arrays of its row, so nothing is shuffled: an array is sorted once and slices of it are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: Subtypes of a family that are kept, labels of a span, and secondary labels.
PER_FAMILY, LABELS, SECONDARY = 3, 4, 3
#: What a wide label loses and a family kept for its strong structure gains.
WIDE, STRONG = -0.15, 0.12
STRUCTURAL = ("ordering", "fill", "continuation")


class Rule(NamedTuple):
    family: str
    subtype: str
    condition: str
    score: float


# Names and scores of subtypes, and the conditions under which they are proposed.
RULES = (
    Rule("summary", "全文整合单中心卡", "single_center_strength >= 0.75", 0.82),
    Rule("summary", "结尾回收卡", "role_tail_summary", 0.78),
    Rule("summary", "开头总领卡", "role_opening", 0.74),
    Rule("summary", "转折后重心卡", "role_after_turn", 0.79),
    Rule("summary", "例证归纳卡", "example_to_theme_strength >= 0.7", 0.77),
    Rule("summary", "多维统摄卡", "branch_focus_strength >= 0.7", 0.73),
    Rule("summary", "问题分析收束卡", "problem_signal_strength >= 0.7", 0.72),
    Rule("summary", "态度/价值落点卡", "value_judgement_strength >= 0.7", 0.76),
    Rule("title", "平实主旨回收卡", "titleability >= 0.75", 0.80),
    Rule("title", "例证归纳回收卡", "example_to_theme_strength >= 0.7", 0.78),
    Rule("title", "转折后重心卡", "role_after_turn", 0.77),
    Rule("title", "多维统摄卡", "branch_focus_strength >= 0.7", 0.74),
    Rule("title", "问题本质判断卡", "problem_signal_strength >= 0.7", 0.75),
    Rule("title", "价值评议卡", "value_judgement_strength >= 0.75", 0.79),
    Rule("fill", "段首总领卡", "role_opening", 0.80),
    Rule("fill", "承上启下桥接卡", "transition_strength >= 0.65", 0.78),
    Rule("fill", "中间解释说明卡", "role_middle_explanation", 0.77),
    Rule("fill", "综合多约束卡", "explanation_strength >= 0.7", 0.72),
    Rule("fill", "尾句总结收束卡", "role_tail_summary", 0.79),
    Rule("fill", "尾句升华拔高卡", "role_tail_lift OR value_judgement_strength >= 0.7", 0.74),
    Rule("ordering", "首尾双锚点卡", "role_first_sentence AND role_last_sentence", 0.84),
    Rule("ordering", "承接并列收束卡", "relation_carry OR relation_parallel", 0.78),
    Rule("ordering", "问题对策案例卡", "counted_points", 0.76),
    Rule("ordering", "固定搭配局部排序卡", "branch_focus_strength >= 0.7", 0.72),
    Rule("continuation", "新落点延展卡", "continuation_openness >= 0.72 AND direction_uniqueness >= 0.58 AND complete_tail AND extension_tail", 0.80),
    Rule("continuation", "问题暴露转对策卡", "problem_signal_strength >= 0.7 AND method_signal_strength >= 0.5 AND complete_tail", 0.82),
    Rule("continuation", "方法路径细化卡", "method_signal_strength >= 0.7 AND complete_tail AND extension_tail", 0.79),
    Rule("continuation", "判断落点补论证卡", "direction_uniqueness >= 0.7 AND complete_tail AND extension_tail", 0.76),
    Rule("continuation", "总结后留白卡", "value_judgement_strength >= 0.7 AND summary_strength >= 0.45 AND complete_tail AND extension_tail", 0.74),
)
FAMILIES = tuple(dict.fromkeys(r.family for r in RULES))
_ENTRY = "array<struct<by: double, place: int, family: string, subtype: string>>"


def subtypes(spans: DataFrame, table: Sequence[Rule] = RULES) -> DataFrame:
    """``spans`` with candidates: by family, its best subtypes (by: minus the score; ties in the order of the rules)."""

    def of(family: str) -> Column:
        own = [(i, r) for i, r in enumerate(table) if r.family == family]
        entries = F.array(*(F.when(F.expr(r.condition), F.struct(F.lit(-r.score).alias("by"), F.lit(i).alias("place"), F.lit(r.family).alias("family"), F.lit(r.subtype).alias("subtype"))) for i, r in own))
        return F.slice(F.array_sort(F.array_compact(entries)), 1, PER_FAMILY).cast(_ENTRY)

    return spans.withColumn("candidates", F.concat(*(of(f) for f in dict.fromkeys(r.family for r in table))))


def of_family(candidates: str, family: str) -> Column:
    """The candidates of one family, best first."""
    return F.filter(candidates, lambda e: e["family"] == family)


#: When a model would be asked about a family's subtypes: the first reason that holds; the two marked "ask" would.
#: Reads family_score, family_rank, gap (to the primary family), second_gap, n_candidates, top_score, second_score, model_on.
MODEL_GATE = rules.reason(
    [
        ("NOT model_on", "llm_disabled"),
        ("family_score < 0.45", "router_score_too_low"),
        ("family_rank > 0 AND gap > 0.06", "non_primary_not_close"),
        ("n_candidates = 1 OR (n_candidates > 1 AND top_score >= 0.75 AND top_score - second_score >= 0.08)", "heuristic_confident"),
        ("n_candidates = 0", "no_heuristic_subtype"),
        ("family_rank = 0", "primary_family_boundary"),
        ("second_gap <= 0.08 OR gap <= 0.04", "close_family_boundary"),
    ],
    "secondary_family_not_ambiguous",
)
ASKED = ("no_heuristic_subtype", "primary_family_boundary", "close_family_boundary")

# By family and a part of the subtype's name, what a text must show for a label to hold, and the reason if it doesn't; the first that fits counts.
COVERAGE: tuple[tuple[str, tuple[str, ...], str, str], ...] = (
    ("ordering", ("首尾",), "opening_anchor AND summary_closure AND ordering_signal", "missing_head_or_tail_ordering_anchor_in_material"),
    ("ordering", ("排序", "承接"), "ordering_signal AND sequence_markers >= 2", "missing_local_order_dependency_in_material"),
    ("ordering", (), "sequence_markers >= 2 OR ordering_signal", "ordering_family_lacks_local_structure_evidence"),
    ("summary", ("结尾",), "summary_closure", "missing_closing_summary_anchor_in_material"),
    ("summary", ("开头",), "opening_anchor", "missing_opening_anchor_in_material"),
    ("summary", ("全文", "单中心"), "many_parts AND stable_center", "material_does_not_cover_enough_support_points_for_full_integration"),
    ("summary", (), "stable_center", "material_main_idea_not_stable_enough"),
    ("title", (), "titleability >= 0.65 AND stable_center", "material_center_not_clear_enough_for_title_naming"),
    ("fill", ("尾句",), "summary_closure", "missing_tail_sentence_closure_in_material"),
    ("fill", (), "transition_strength >= 0.62 OR explanation_strength >= 0.62", "material_lacks_local_fill_gap_evidence"),
    ("continuation", (), "complete_tail AND extension_tail AND continuation_openness >= 0.62 AND direction_uniqueness >= 0.5", "continuation_requires_complete_tail_sentence_with_unique_extension_signal"),
)


def coverage(family: str, subtype: str) -> tuple[str, str]:
    """The condition of a label and the reason if it fails."""
    return next(((c, r) for f, parts, c, r in COVERAGE if f == family and (not parts or any(p in subtype for p in parts))), ("true", ""))


def governed(spans: DataFrame, table: Sequence[Rule] = RULES, wide: Sequence[str] = ()) -> DataFrame:
    """``spans`` (candidates, family_scores map, strong_order, and what COVERAGE reads) with labels, primary, secondary and downgraded.

    Labels are the valid subtypes, each name once, and the families; wide ones weigh less.  The first
    ``LABELS`` stay; if all of them are wide the last gives way to the best fine one; if the text
    shows a strong order and none of the structural families is among them, the last gives way to the best
    of these.  The primary label is the first fine one.
    """
    tests = list(dict.fromkeys(coverage(r.family, r.subtype) for r in table))
    out = spans.withColumn("__x_flags", F.array(*(F.when(F.expr(condition), F.lit("")).otherwise(F.lit(why)) for condition, why in tests)))
    place_of = {(r.family, r.subtype): tests.index(coverage(r.family, r.subtype)) for r in table}

    def verdict(e: Column) -> Column:
        place = F.lit(-1)
        for (family, subtype), i in place_of.items():
            place = F.when((e["family"] == family) & (e["subtype"] == subtype), i).otherwise(place)
        return F.when(place >= 0, F.get(F.col("__x_flags"), place)).otherwise(F.lit(""))

    ordered = F.array_sort("candidates")
    checked = F.transform(ordered, lambda e: F.struct(e["by"].alias("by"), e["family"].alias("family"), e["subtype"].alias("subtype"), verdict(e).alias("why")))
    out = out.withColumn("__x_checked", checked)
    valid = F.filter("__x_checked", lambda e: e["why"] == "")
    names = F.transform(valid, lambda e: e["subtype"])
    once = F.filter(F.transform(valid, lambda e, i: F.struct(e["by"].alias("by"), e["family"].alias("family"), e["subtype"].alias("label"), i.alias("i"))), lambda e: F.array_position(names, e["label"]) == e["i"] + 1)
    is_wide = lambda label: label.isin(*wide) if wide else F.lit(False)
    subtype_rows = F.transform(once, lambda e: F.struct((e["by"] - F.when(is_wide(e["label"]), WIDE).otherwise(0.0)).alias("by"), e["i"].alias("place"), e["family"].alias("family"), e["label"].alias("label"), is_wide(e["label"]).alias("wide")))
    family_rows = F.transform(
        F.filter(F.map_entries("family_scores"), lambda f: ~F.array_contains(names, f["key"])),
        lambda f: F.struct((-f["value"] - F.when(is_wide(f["key"]), WIDE).otherwise(0.0)).alias("by"), (F.lit(1000) - F.round(f["value"] * 900)).cast("int").alias("place"), f["key"].alias("family"), f["key"].alias("label"), F.lit(True).alias("wide")),
    )
    entry = "array<struct<by: double, place: int, family: string, label: string, wide: boolean>>"
    rounded = F.transform(F.concat(subtype_rows.cast(entry), family_rows.cast(entry)), lambda e: F.struct(F.round(e["by"], 4).alias("by"), e["place"].alias("place"), e["family"].alias("family"), e["label"].alias("label"), e["wide"].alias("wide")))
    out = out.withColumn("__x_all", F.array_sort(rounded))
    out = out.withColumn("__x_top", F.slice("__x_all", 1, LABELS))
    fine = F.get(F.filter("__x_all", lambda e: ~e["wide"]), F.lit(0))
    all_wide = ~F.exists("__x_top", lambda e: ~e["wide"]) & fine.isNotNull() & (F.size("__x_top") > 0)
    replaced = lambda top, x: F.concat(F.slice(top, 1, F.greatest(F.size(top) - 1, F.lit(0))), F.array(x))
    out = out.withColumn("__x_top", F.when(all_wide, replaced(F.col("__x_top"), fine)).otherwise(F.col("__x_top")))
    built = F.get(F.filter("__x_all", lambda e: e["family"].isin(*STRUCTURAL)), F.lit(0))
    missing = F.col("strong_order") & built.isNotNull() & ~F.exists("__x_top", lambda e: e["label"] == built["label"])
    # entries fewer than there are places all stay, so a structural one can only be missing from a full list
    out = out.withColumn("__x_top", F.when(missing, replaced(F.col("__x_top"), built)).otherwise(F.col("__x_top")))
    primary = F.coalesce(F.get(F.filter("__x_top", lambda e: ~e["wide"]), F.lit(0)), F.get(F.col("__x_top"), F.lit(0)))
    out = out.withColumns({"labels": F.transform("__x_top", lambda e: e["label"]), "primary": primary["label"], "downgraded": F.transform(F.filter("__x_checked", lambda e: e["why"] != ""), lambda e: F.struct(e["subtype"].alias("label"), e["family"].alias("family"), e["why"].alias("reason")))})
    out = out.withColumn("secondary", F.slice(F.filter("labels", lambda x: x != F.col("primary")), 1, SECONDARY))
    return out.drop("__x_flags", "__x_checked", "__x_all", "__x_top")

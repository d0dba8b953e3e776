"""Groups of six units whose order can be asked for: merging, relations between units, and gates.

Units are an array of texts in a row; markers are searched in each, pairs are scored, and the
best pairs are merged, all by columns.  Rules are rows of what must hold and what it adds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIX, MOST = 6, 12
#: Least score of a pair that is merged before others, and of a first, a last and a weak last unit; like units that are too many.
MERGED, FIRST, LAST, WEAK_LAST, MANY = 0.10, 0.50, 0.54, 0.40, 4
SHORT_UNIT, LONG_PAIR = 34, 88
OPEN_ENDS = "[。！？!?；;，,：:.]$"


class Markers(NamedTuple):
    """Words by what they tell of a unit; pairs are (in the left unit, any of these in the right)."""

    definition: tuple[str, ...]
    pronoun: tuple[str, ...]
    context: tuple[str, ...]
    turning: tuple[str, ...]
    parallel: tuple[str, ...]
    problem: tuple[str, ...]
    solution: tuple[str, ...]
    question: tuple[str, ...]
    closing: tuple[str, ...]
    summary: tuple[str, ...]
    conclusion: tuple[str, ...]
    countermeasure: tuple[str, ...]
    cause: tuple[str, ...]
    beginning: tuple[str, ...]
    additive: tuple[str, ...]
    final: tuple[str, ...]
    correlative: tuple[tuple[str, tuple[str, ...]], ...]
    condition: tuple[tuple[str, tuple[str, ...]], ...]


# The Chinese markers.
CHINESE = Markers(
    definition=("就是", "是指", "指的是"),
    pronoun=("这", "那", "其", "该", "此", "这些", "那些", "他们", "它们"),
    context=("对此", "与此同时", "另一方面", "此外", "这也", "因此", "所以"),
    turning=("虽然", "但是", "可是", "然而", "不过", "却"),
    parallel=("同时", "同样", "此外", "也", "另一方面"),
    problem=("问题在于", "问题是", "难点在于", "困境在于"),
    solution=("因此", "所以", "应当", "应该", "必须", "要"),
    question=("为什么", "如何", "怎么办", "怎样"),
    closing=("因此", "所以", "可见", "看来", "总之", "由此"),
    summary=("总之", "可见", "因此", "由此", "这意味着", "归根结底"),
    conclusion=("所以", "因此", "因而", "故而", "故", "于是", "可见", "看来", "由此"),
    countermeasure=("应该", "应当", "应", "需要", "要", "必须", "通过", "采取", "措施", "方式", "方法", "渠道", "途径", "才能"),
    cause=("因为", "由于", "缘于"),
    beginning=("首先", "第一", "起初", "一开始"),
    additive=("例如", "比如", "此外", "另外", "同时", "不仅如此"),
    final=("最后", "最终", "总结判断", "归结起来"),
    correlative=(("不仅", ("而且", "也", "还")), ("一方面", ("另一方面",)), ("既", ("又",))),
    condition=(("如果", ("那么", "就", "则", "才")), ("只有", ("才",))),
)


def has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def starts(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


def paired(left: Column, right: Column, pairs: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    out = F.lit(False)
    for word, others in pairs:
        out = out | (left.contains(word) & has(right, others))
    return out


def _sum(base: float, rules: list[tuple[Column, float]]) -> Column:
    total = F.lit(base)
    for condition, value in rules:
        total = total + F.when(condition, value).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) + 1e-9, 4)


def pair_bond(left: Column, right: Column, m: Markers) -> Column:
    """(score, reason): how well two neighbours go together, and the last of the rules that says so."""
    # What each bond adds.
    bonds = [
        ("reference_binding_pair", starts(right, m.pronoun + m.context), 0.30),
        ("transition_binding_pair", has(right, m.turning + m.parallel), 0.26),
        ("problem_solution_pair", has(left, m.problem) & has(right, m.solution), 0.28),
        ("parallel_binding_pair", paired(left, right, m.correlative), 0.30),
        ("condition_result_pair", paired(left, right, m.condition), 0.24),
    ]
    sizes = [((F.length(left) <= SHORT_UNIT) & (F.length(right) <= SHORT_UNIT), 0.12), (F.length(left) + F.length(right) > LONG_PAIR, -0.18), (has(right, m.closing), -0.08)]
    reason = F.lit("adjacent_short_binding")
    for name, condition, _ in bonds:
        reason = F.when(condition, name).otherwise(reason)
    return F.struct(_sum(0.0, [(c, v) for _, c, v in bonds] + sizes).alias("score"), reason.alias("reason"))


def relation(left: Column, right: Column, m: Markers) -> Column:
    """(kind, reason) of the first relation that holds between neighbours, or null."""
    cases = [
        (starts(right, m.pronoun + m.context), "local_binding", "reference_dependency"),
        (has(right, m.turning + m.parallel), "local_binding", "transition_binding"),
        (has(left, m.problem) & has(right, m.solution), "precedence", "problem_before_solution"),
        (paired(left, right, m.condition), "precedence", "condition_before_result"),
        (has(left, m.definition) & ~has(right, m.definition), "precedence", "definition_before_expansion"),
        (has(left, m.cause) & has(right, m.closing + m.conclusion), "precedence", "cause_before_conclusion"),
    ]
    out = F.lit(None).cast("struct<kind: string, reason: string>")
    for condition, kind, why in reversed(cases):
        out = F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("reason"))).otherwise(out)
    return out


def first_score(u: Column, i: Column, m: Markers) -> Column:
    return _sum(
        0.42,
        [
            (i == 0, 0.10), (has(u, m.definition + m.problem + m.question), 0.18), (has(u, m.beginning), 0.14), (starts(u, m.pronoun + m.context), -0.26),
            (has(u, m.closing + m.countermeasure), -0.22), (has(u, m.additive), -0.16),
        ],
    )


def last_score(u: Column, i: Column, n: Column, m: Markers) -> Column:
    end = i == n - 1
    return _sum(
        0.32,
        [
            (end, 0.12), (has(u, m.closing + m.summary + m.conclusion), 0.28), (end & has(u, m.final), 0.14), (has(u, m.countermeasure), 0.18), (has(u, m.definition + m.problem), -0.14),
            (starts(u, m.pronoun + m.context), -0.10),
        ],
    )


def _neighbours(units: str) -> Column:
    n = F.size(units)
    return F.when(n >= 2, F.zip_with(F.slice(units, 1, n - 1), F.slice(units, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a: string, b: string>>"))


def six_units(rows: DataFrame, units: str = "units", m: Markers = CHINESE) -> DataFrame:
    """``rows`` with six (array<string>) and grouped (how many of them are merged pairs); six is null where no six can be made.

    Six to twelve units: of more than six the best pairs of neighbours are merged, none of which overlap; of equal pairs the later one first.
    """
    n = F.size(units)
    need = n - SIX
    bonds = F.transform(_neighbours(units), lambda p, i: F.struct((-pair_bond(p["a"], p["b"], m)["score"]).alias("by"), (-i).alias("at")))
    out = rows.withColumn("__x_pairs", F.array_sort(bonds))
    good = F.filter("__x_pairs", lambda p: -p["by"] >= MERGED)
    none = F.array().cast("array<int>")
    chosen = F.aggregate(
        F.when(F.size(good) < need, F.col("__x_pairs")).otherwise(good), none,
        lambda acc, p: F.when((F.size(acc) < need) & ~F.exists(acc, lambda c: F.abs(c + p["at"]) <= 1), F.array_append(acc, (-p["at"]).cast("int"))).otherwise(acc),
    )
    out = out.withColumn("__x_chosen", F.when(need > 0, chosen).otherwise(none))
    rest = F.col(units)

    def merged(u: Column, i: Column) -> Column:
        follow = F.get(rest, i + 1)
        glue = F.when(u.rlike(OPEN_ENDS), "").otherwise("，")
        return F.when(F.array_contains("__x_chosen", i - 1), F.lit(None)).when(F.array_contains("__x_chosen", i), F.concat(u, glue, follow)).otherwise(u)

    fits = n.between(SIX, MOST) & (need <= F.floor(n / 2)) & (F.size("__x_chosen") == F.greatest(need, F.lit(0)))
    six = F.filter(F.transform(rest, merged), lambda u: u.isNotNull())
    return out.withColumns({"six": F.when(fits, six), "grouped": F.when(fits, F.size("__x_chosen"))}).drop("__x_pairs", "__x_chosen")


def group_gates(rows: DataFrame, units: str = "six", m: Markers = CHINESE) -> DataFrame:
    """``rows`` with first_like, last_like (places), n_local, n_precedence, strict and weak, the first reason of either gate.

    strict: the first and the last unit must be alike their places, not too many others, and something must tie the order;
    weak: the last unit may miss its place if its score isn't too low.
    """
    n = F.size(units)
    firsts = F.transform(units, lambda u, i: first_score(u, i, m))
    lasts = F.transform(units, lambda u, i: last_score(u, i, n, m))
    tied = F.filter(F.transform(_neighbours(units), lambda p: relation(p["a"], p["b"], m)), lambda r: r.isNotNull())
    out = rows.withColumns({"__x_f": firsts, "__x_l": lasts, "__x_t": tied})

    def places(scores: str, least: float) -> Column:
        return F.filter(F.transform(scores, lambda s, i: F.when(s >= least, i)), lambda i: i.isNotNull())

    out = out.withColumns(
        {
            "first_like": places("__x_f", FIRST), "last_like": places("__x_l", LAST), "n_local": F.size(F.filter("__x_t", lambda r: r["kind"] == "local_binding")),
            "n_precedence": F.size(F.filter("__x_t", lambda r: r["kind"] == "precedence")),
        }
    )
    is_six = F.coalesce(n == SIX, F.lit(False))
    last_held = F.array_contains("last_like", SIX - 1)
    crowd = lambda c: F.size(c) >= MANY
    loose = F.col("n_local") + F.col("n_precedence") < 1
    start = F.when(~is_six, "group_size_not_six").when(~F.array_contains("first_like", 0), "first_unit_unstable")
    strict = start.when(~last_held, "last_unit_unstable").when(crowd("first_like"), "too_many_first_like_units").when(crowd("last_like"), "too_many_last_like_units")
    weak = start.when(crowd("first_like"), "too_many_first_like_units").when(crowd("last_like"), "too_many_last_like_units").when(loose, "ordering_constraints_too_weak")
    weak = weak.when(last_held, "ordered_unit_group_ready").when(F.element_at("__x_l", -1) < WEAK_LAST, "last_unit_too_weak_even_for_weak_formal").otherwise("weak_tail_accept")
    return out.withColumns({"strict": strict.when(loose, "ordering_constraints_too_weak").otherwise("ordered_unit_group_ready"), "weak": weak}).drop("__x_f", "__x_l", "__x_t")

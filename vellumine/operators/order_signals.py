"""Signals of units in an order, from their texts: roles, openers, bonds of neighbours, risks.

A span's units are its lines where it is a group in blocks or an ordered group, the parts between
circled numbers, or its sentences; of seven to twelve the best neighbours are merged to six.  Each
unit is scanned once; neighbours are compared on what was found.  All of a span stays in its row.

Edge cases: a text without units has opener and strengths 0 and overlap 1; a single unit overlaps
wholly with itself; languages without a pack have no markers; repeated rows are worked out each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from . import neutral, rules, units
from .rules import score

#: Kinds whose lines, or parts between circled numbers, are their units.
GROUPED = ("sentence_block_group", "ordered_unit_group", "weak_formal_order_group")
CIRCLED = "[①②③④⑤⑥⑦⑧⑨⑩]\\s*"
#: Most bonds that count.
MOST_BONDS = 4

# Roles by the first group that occurs; what each group adds to a unit that may open.
ROLES = (
    ("summary", "closing"), ("action", "countermeasure"), ("problem", "order_problem"), ("question", "order_question"), ("definition", "definition"), ("example", "order_example"),
    ("dependent", None), ("turning", "order_turning"), ("parallel", "order_parallel"), ("timeline", "order_action"), ("viewpoint", "viewpoint"),
)
OPENER = {"definition": 0.32, "order_problem": 0.22, "claim": 0.18, "order_closing": -0.18, "order_turning": -0.10}
OPENER_BASE, LEANING, IN_CONTEXT, FIRST, BEGINNING = 0.28, -0.28, -0.22, 0.06, 0.16


def _leans(u: Column) -> Column:
    """Whether a unit begins by pointing back."""
    return M.starts(u["start"], "pronoun") | M.starts(u["start"], "context")


def role(u: Column, last: Column) -> Column:
    out = F.when(last, "tail_statement").otherwise("statement")
    for name, group in reversed(ROLES):
        out = F.when(_leans(u) if group is None else M.has(u["hits"], group), name).otherwise(out)
    return out


def opener(u: Column, i: Column) -> Column:
    """How well a unit may open."""
    total = F.lit(OPENER_BASE)
    for group, value in OPENER.items():
        total = total + F.when(M.has(u["hits"], group), value).otherwise(0.0)
    total = total + F.when(M.starts(u["start"], "pronoun") | M.has(u["hits"], "plain_example"), LEANING).otherwise(0.0)
    total = total + F.when(M.starts(u["start"], "context"), IN_CONTEXT).otherwise(0.0)
    total = total + F.when(i == 0, FIRST).otherwise(0.0) + F.when((i == 0) & M.has(u["hits"], "beginning"), BEGINNING).otherwise(0.0)
    return T.rounded(T.clip(total), 4)


def bound(a: Column, b: Column) -> Column:
    """Whether a unit is bound to the one before it."""
    one = lambda g: M.has(a["hits"], g)
    two = lambda g: M.has(b["hits"], g)
    return (
        _leans(b) | two("order_turning") | two("order_parallel") | two("follow") | (one("order_question") & two("answer")) | (one("order_problem") & two("order_solution"))
        | (one("only") & two("then_only")) | (one("if") & two("then"))
    )


def with_units(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` (lang, candidate_type, body) with the array of texts ``units``."""
    c = F.col
    grouped = c("candidate_type").isin(*GROUPED)
    lines = F.filter(F.transform(F.split(body, r"\R"), T.strip), lambda x: x != "")
    parts = F.filter(F.transform(F.split(body, CIRCLED), T.strip), lambda x: x != "")
    raw = F.when(grouped & c(body).contains("\n") & (F.size(lines) > 0), lines).when(grouped & (F.size(parts) > 0), parts).otherwise(T.sentences(c(body), c("lang")))
    rows = rows.withColumns({"__x_raw": raw, "__x_lined": grouped & c(body).contains("\n") & (F.size(lines) > 0)})
    fits = ~c("__x_lined") & F.size("__x_raw").between(units.SIX + 1, units.MOST)
    rows = units.six_units(rows.withColumn("__x_many", F.when(fits, c("__x_raw")).otherwise(F.array().cast("array<string>"))), "__x_many")
    return rows.withColumn("units", F.when(fits & c("six").isNotNull(), c("six")).otherwise(c("__x_raw"))).drop("__x_raw", "__x_lined", "__x_many", "six", "grouped")


# Weights.
LAYERS: list[rules.Layer] = [
    {
        "unique_opener_score": "CASE WHEN n_units = 0 THEN 0e0 ELSE " + score({"best_opener": 0.68, "greatest(0e0, best_opener - second_opener)": 0.32}) + " END",
        "function_overlap_score": "CASE WHEN n_units <= 1 THEN 1e0 ELSE " + score({"(CAST(n_units - n_roles AS DOUBLE) / (n_units - 1))": 0.72, "directive_share": 0.28}) + " END",
        "temporal_order_strength": score({"least(n_timed, 4)": 0.18}, {"in_turn": 0.18}),
        "action_sequence_irreversibility": score({"least(n_actions, 4)": 0.14, "least(n_steps, 3)": 0.18}),
    },
    {
        "discourse_progression_strength": score(
            {
                "opening_signal_strength": 0.22, "local_binding_strength": 0.18, "closing_signal_strength": 0.22, "sequence_integrity": 0.20, "temporal_order_strength": 0.08, "(1 - function_overlap_score)": 0.10,
            }
        ),
    },
    {"context_closure_score": score({"discourse_progression_strength": 0.34, "closing_signal_strength": 0.26, "sequence_integrity": 0.22, "(1 - context_dependency)": 0.18})},
    {
        "exchange_risk": score(
            {
                "function_overlap_score": 0.30, "(1 - least(1e0, binding_pair_count / 3e0))": 0.20, "(1 - unique_opener_score)": 0.18, "(1 - context_closure_score)": 0.12, "m_t_order_parallel": 0.10,
                "directive_share": 0.06, "(1 - temporal_order_strength)": 0.02, "(1 - action_sequence_irreversibility)": 0.02,
            }
        ),
    },
    {
        "multi_path_risk": score(
            {
                "exchange_risk": 0.34, "function_overlap_score": 0.22, "(1 - unique_opener_score)": 0.18, "(1 - least(1e0, binding_pair_count / 3e0))": 0.14, "(1 - discourse_progression_strength)": 0.06,
                "(1 - context_closure_score)": 0.06,
            }
        ),
    },
]
NUMBERS = (
    "unique_opener_score function_overlap_score temporal_order_strength action_sequence_irreversibility discourse_progression_strength context_closure_score exchange_risk multi_path_risk"
).split()


def unit_signals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``units`` and ``lang``: roles, openers, bonds and counts over the units."""
    c = F.col
    rows = rows.withColumn("scanned", M.scan(c("units"), c("lang")))
    n = F.size("scanned")
    neighbours = F.zip_with(F.slice("scanned", 1, F.greatest(n - 1, F.lit(0))), F.slice("scanned", 2, F.greatest(n - 1, F.lit(0))), bound)
    how_many = lambda group: F.size(F.filter("scanned", lambda u: M.has(u["hits"], group)))
    rows = rows.withColumns(
        {
            "n_units": n, "roles": F.transform("scanned", lambda u, i: role(u, i == n - 1)), "openers": F.sort_array(F.transform("scanned", opener), asc=False), "bonds": F.filter(neighbours, lambda x: x),
            "n_timed": F.aggregate("scanned", F.lit(0), lambda acc, u: acc + M.count(u["hits"], "timed")), "in_turn": F.exists("scanned", lambda u: M.has(u["hits"], "before") & M.has(u["hits"], "after")),
            "n_actions": how_many("order_action"), "n_steps": how_many("steps"), "directive_share": F.when(n == 0, 0.0).otherwise(how_many("countermeasure") / n),
        }
    )
    return rows.withColumns(
        {
            "best_opener": F.coalesce(F.get("openers", 0), F.lit(0.0)), "second_opener": F.coalesce(F.get("openers", 1), F.lit(0.0)), "binding_pair_count": F.least(F.size("bonds"), F.lit(MOST_BONDS)).cast("double"),
            "n_roles": F.size(F.array_distinct("roles")),
        }
    )


def signals(spans: DataFrame) -> DataFrame:
    """All columns of ``neutral`` and of this module, for rule sets to read."""
    rows = neutral.signals(spans)
    return rules.apply(unit_signals(with_units(rows)), LAYERS)


def order_signals(spans: DataFrame) -> DataFrame:
    """span_id, candidate_type, roles, n_units, binding_pair_count and the numbers of NUMBERS."""
    return signals(spans).select("span_id", "candidate_type", "roles", "n_units", "binding_pair_count", *NUMBERS)

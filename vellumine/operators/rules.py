"""Scores and decisions as rows of data.

A score is a base, a weight for each signal and a bonus for each condition; a decision is an
ordered list of conditions with their results.  Both become SQL expressions, so that a table
of rules is one chain of columns inside the JVM: no shuffle, no Python, whatever its length.
``layers`` are applied one after another; an expression sees the columns of earlier layers.

Missing signals count as 0: ``filled`` says so once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layer = Mapping[str, str]


def number(x: float) -> str:
    """A double literal, not a decimal one."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def weighted(weights: Mapping[str, float], bonuses: Mapping[str, float] | None = None, base: float = 0.0) -> str:
    """base + the weighted signals (names or expressions) + the bonuses of conditions that hold."""
    parts = [number(base)] if base else []
    parts += [f"{number(w)} * {signal}" for signal, w in weights.items()]
    parts += [f"CASE WHEN {condition} THEN {number(b)} ELSE 0e0 END" for condition, b in (bonuses or {}).items()]
    return " + ".join(parts) if parts else "0e0"


def unit(expression: str) -> str:
    """Cut to [0, 1]."""
    return f"greatest(0e0, least(1e0, {expression}))"


def rounded(expression: str, places: int = 4) -> str:
    return f"round({expression} + 1e-9, {places})"


def score(weights: Mapping[str, float], bonuses: Mapping[str, float] | None = None, base: float = 0.0) -> str:
    """A weighted score in [0, 1], to four places."""
    return rounded(unit(weighted(weights, bonuses, base)))


def mean(*expressions: str) -> str:
    return rounded(unit(f"({' + '.join(expressions)}) / {number(len(expressions))}"))


def first(cases: Iterable[tuple[str, str]], default: str) -> str:
    """The result of the first condition that holds; conditions and results are expressions."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {result}" for condition, result in cases) + f" ELSE {default} END"


def reason(cases: Iterable[tuple[str, str]], default: str = "") -> str:
    """As ``first``, with results as words."""
    return first(((condition, f"'{word}'") for condition, word in cases), f"'{default}'")


def by_value(column: str, values: Mapping[str, float | str], default: float | str) -> str:
    """An expression or number chosen by the value of a column."""
    text = lambda x: x if isinstance(x, str) else number(x)
    return first(((f"{column} = '{k}'", text(v)) for k, v in values.items()), text(default))


def filled(rows: DataFrame, signals: Sequence[str]) -> DataFrame:
    """``rows`` with missing signals as 0."""
    return rows.withColumns({s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in signals})


def apply(rows: DataFrame, layers: Iterable[Layer]) -> DataFrame:
    """``rows`` with the columns of all layers."""
    for layer in layers:
        rows = rows.withColumns({name: F.expr(text) for name, text in layer.items()})
    return rows


def ranked(scores: Mapping[str, str]) -> str:
    """The name with the largest of the scores (expressions), the first of equals."""
    top = f"greatest({', '.join(scores.values())})"
    return reason((f"{text} = {top}", name) for name, text in scores.items())

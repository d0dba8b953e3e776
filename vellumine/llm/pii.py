"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for card numbers, mod-97 for
bank account numbers, ranges and digit counts), and context words near a span raise its
score.  Base kinds (email, ip, card, phone) stay whatever their score; the added kinds (iban,
short card numbers, social security numbers) stay only from ``MIN_SCORE`` on, so that digits
in clean text are left alone.

A regular expression gives its matches and, by splitting, the gaps between them; the start of
a match is the sum of the lengths of the gaps and matches before it.  Positions are code
points, ends exclusive.  Repetitions are possessive where that changes no match, so that very
long runs take linear time and no deep recursion; a cheap test of the text spares most rows
the expressions of a kind.

Edge cases: a null text counts as empty and has no spans; rows are independent, so repeated
rows get equal results; whole texts are searched; an empty table gives an empty result; the
columns of the input are passed on beside ``pii``, but one of that name gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which context words count.
CONTEXT = 40
#: Least score of spans of the added kinds.
MIN_SCORE = 0.8
SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"

# Context words by kind, in English, French, German and Spanish.
CONTEXT_WORDS = {
    "email": "mail|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección|serveur",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|telefon|téléphone|teléfono|fax",
    "iban": "iban|account|bank|konto|compte|cuenta|banque",
    "short_card": "card|visa|amex|credit|karte|carte|tarjeta",
    "ssn": "ssn|social security",
}

# Characters of an account number (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: Country, two check digits and the rest, which may stand in groups; as long as the country has it,
#: so that words after the number are never taken for a part of it.
IBAN = "(?:" + "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{size - 4}}}" for size, names in IBAN_LENGTHS.items()) + ")"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int"), i),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _luhn_digit(d: Column, place: Column) -> Column:
    """The share of a digit at a place counted from the right."""
    return F.when(place % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def mod97(account: Column) -> Column:
    """Whether an account number of capital letters and digits leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: _append97(acc, _value(letters, turned, i)))
    return rest == 1


def _value(letters: Column, text: Column, place: Column) -> Column:
    return F.position(F.substring(text, place, F.lit(1)), letters) - 1


def _append97(acc: Column, value: Column) -> Column:
    return F.when(value < 10, acc * 10 + value).otherwise(acc * 100 + value) % 97


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    gate: a test that every text with a span passes; pattern: what is matched; valid: the
    checks of a match, given the match, the character before and the one after it.
    """

    name: str
    gate: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column, Column, Column], Column]
    score: float
    base: bool


def _no_alnum(x: Column) -> Column:
    return ~x.rlike("[A-Za-z0-9]")


def _octets(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


KINDS = (
    Kind(
        "email",
        lambda t: t.contains("@"),
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m, before, after: F.lit(True),
        0.8,
        True,
    ),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda m, before, after: _octets(m), 0.6, True),
    Kind(
        "card",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda m, before, after: F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m)),
        0.8,
        True,
    ),
    Kind(
        "phone",
        lambda t: t.contains("+"),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m, before, after: F.length(digits_of(m)).between(8, 15),
        0.6,
        True,
    ),
    Kind(
        "iban",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        IBAN,
        lambda m, before, after: _no_alnum(before)
        & _no_alnum(after)
        & mod97(F.replace(m, F.lit(" "), F.lit(""))),
        0.85,
        False,
    ),
    Kind(
        "short_card",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda m, before, after: _no_alnum(before) & _no_alnum(after) & F.length(digits_of(m)).between(13, 15) & luhn(digits_of(m)),
        0.6,
        False,
    ),
    Kind(
        "ssn",
        lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda m, before, after: _no_alnum(before) & _no_alnum(after) & ~before.contains("-") & ~after.contains("-") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        0.6,
        False,
    ),
)
#: What a context word adds to a score.
BONUS = 0.2
#: Numbers of a run whose sum is kept; characters of a piece of text (more than CONTEXT).
RUN, PIECE = 64, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though lambdas in it use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, x: acc + x)


def _sums_before(sizes: Column, levels: int = 2) -> Column:
    """For each of the numbers, the sum of those before it.

    Sums of runs of RUN numbers, summed up in the same way, leave less than RUN numbers to add
    for each place, so the work grows with their count and no list is copied for each.
    """
    n = F.size(sizes)
    if levels == 0:
        return F.transform(sizes, lambda x, i: _total(F.slice(sizes, 1, i)))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / RUN).cast("int")), lambda k: _total(F.slice(sizes, (k * RUN + 1).cast("int"), RUN)))
    placed = lambda heads: F.transform(sizes, lambda x, i: F.get(heads, F.floor(i / RUN).cast("int")) + _total(F.slice(sizes, i - i % RUN + 1, i % RUN)))
    return _let(runs, lambda r: _let(_sums_before(r, levels - 1), placed))


def _spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order.

    What stands around a match is taken from pieces of PIECE characters, so that no look-up walks
    through the text from its beginning: the work grows with the text and with its matches.
    """
    none = F.array().cast(SPAN)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def placed(found: Column, gaps: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m))
        spans = lambda at: F.transform(
            found, lambda m, i: F.struct(m.alias("m"), (F.get(at, i) + F.get(gaps, i)).alias("start"), (F.get(at, i) + F.get(gaps, i) + F.length(m)).alias("end"))
        )
        return _let(_let(steps, lambda x: _sums_before(x)), lambda at: checked(spans(at), pieces))

    def part(pieces: Column, start: Column, size: Column) -> Column:
        """Up to PIECE characters from ``start`` on."""
        first = F.floor(start / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
        return F.substring(two, (start - first * PIECE + 1).cast("int"), size)

    def checked(spans: Column, pieces: Column) -> Column:
        def before(x: Column) -> Column:
            return F.when(x["start"] > 0, part(pieces, x["start"] - 1, F.lit(1))).otherwise("")

        def after(x: Column) -> Column:
            return part(pieces, x["end"], F.lit(1))

        def score(x: Column) -> Column:
            low = F.greatest(x["start"] - CONTEXT, F.lit(0))
            near = F.lower(F.concat(part(pieces, low, x["start"] - low), F.lit(" "), part(pieces, x["end"], F.lit(CONTEXT))))
            return F.lit(kind.score) + F.when(near.rlike(rf"(?:^|[^a-z])(?:{CONTEXT_WORDS[kind.name]})(?:$|[^a-z])"), F.lit(BONUS)).otherwise(F.lit(0.0))

        good = F.filter(spans, lambda x: kind.valid(x["m"], before(x), after(x)))
        scored = F.transform(good, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
        return scored if kind.base else F.filter(scored, lambda x: x["score"] >= MIN_SCORE)

    spans = _let(found, lambda f: _let(gaps, lambda g: _let(pieces, lambda p: placed(f, g, p))))
    return F.when(kind.gate(text), spans.cast(SPAN)).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``pii``: spans by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c != "pii"]
    return docs.select(*kept, F.concat(*(_spans(text, k) for k in KINDS)).alias("pii"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, n_added and max_score."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    names = [k.name for k in KINDS if k.base]
    base = F.filter("pii", lambda x: x["kind"].isin(names))

    def count(name: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == name)).cast("bigint").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *map(count, names),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x["kind"].isin(names))).cast("bigint").alias("n_added"),
        F.array_max(F.transform("pii", lambda x: x["score"])).alias("max_score"),
    )

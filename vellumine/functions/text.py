"""Text scalars as columns: cleaning, splitting, hashing, tokens, overlap, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\x01"
#: Numbers of an array whose sum is kept when sums are run up.
RUN = 64
# Marks and what they stand for.
MARKS, PLAIN = "\u3000，。；：！？“”‘’", " ,.;:!?\"\"''"
# Pairs that say nothing of a text's matter.
STOP_PAIRS = ("正确", "答案", "选项", "题目", "材料", "解析", "文段", "根据", "一项", "的是")
#: Sentence terminators by kind of language; ASCII full stops end no Chinese sentence.
TERMINATORS = {"zh": "。！？!?", "other": "。！？!?."}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean(x: Column) -> Column:
    """Line ends to LF, three or more of them to two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def pieces(x: Column) -> Column:
    """Non-empty stripped parts between cut marks."""
    return F.filter(F.transform(F.split(x, CUT), strip), lambda p: p != "")


def paragraphs(x: Column, lang: Column) -> Column:
    """Parts between blank lines for Chinese, between line feeds elsewhere."""
    return pieces(F.when(lang == "zh", F.regexp_replace(x, r"\n\s*\n", CUT)).otherwise(F.regexp_replace(x, r"\n+", CUT)))


def sentences(x: Column, lang: Column) -> Column:
    """Sentences with their terminators; paragraph ends end sentences too."""
    ended = F.when(lang == "zh", F.regexp_replace(x, f"([{TERMINATORS['zh']}])", f"$1{CUT}")).otherwise(
        F.regexp_replace(x, f"([{TERMINATORS['other']}])", f"$1{CUT}")
    )
    return pieces(F.regexp_replace(ended, r"\n+", CUT))


def words(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}0-9]+"), lambda w: w != "")


def tokens(x: Column) -> Column:
    """The set of ASCII words of two letters or more and of pairs of Chinese characters, those that say nothing left out.

    Characters between Chinese ones are skipped, so pairs run across them.
    """
    low = F.lower(x)
    pairs = F.regexp_extract_all(F.regexp_replace(low, "[^一-鿿]+", ""), F.lit("(?=(..))"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0)), pairs)), lambda w: ~w.isin(*STOP_PAIRS))


def support(evidence: Column, candidate: Column) -> Column:
    """(n_shared, n_candidate, ratio) of two token sets: how much of the candidate stands in the evidence; ratio 0 where one is empty."""
    shared = F.size(F.array_intersect(evidence, candidate))
    ratio = F.when(F.size(candidate) > 0, F.round(shared / F.size(candidate) + 1e-9, 4)).otherwise(0.0)
    return F.struct(shared.alias("n_shared"), F.size(candidate).alias("n_candidate"), ratio.alias("ratio"))


def haystack(x: Column, lang: Column) -> Column:
    """The text in which markers are searched: as is for Chinese, else spaced words."""
    return F.when(lang == "zh", x).otherwise(F.concat(F.lit(" "), F.array_join(words(x), " "), F.lit(" ")))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def normalised_hash(x: Column) -> Column:
    """SHA-1 of the text without white space, full-width and curly marks as their ASCII forms."""
    return F.sha1(F.regexp_replace(F.translate(strip(x), MARKS, PLAIN), r"\s+", ""))


def fingerprint(x: Column) -> Column:
    """The first 500 letters and digits."""
    return F.substring(F.regexp_replace(x, r"[^\p{L}0-9]+", ""), 1, 500)


def shingles(x: Column, size: int = 3) -> Column:
    """The set of character n-grams; a text no longer than one is its own."""
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= size, F.array(x)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size))))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains_mostly(a: Column, b: Column, ratio: float = 0.8) -> Column:
    """Whether the shorter text stands in the longer and isn't much shorter."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) > 0) & long.contains(short) & (F.length(short) / F.length(long) >= ratio)


def marker_strength(count: Column) -> Column:
    """min(1, .18 n + .30 if n > 0), to four places."""
    return F.round(F.least(F.lit(1.0), count * 0.18 + F.when(count > 0, 0.30).otherwise(0.0)), 4)


def question_marker_score(count: Column) -> Column:
    return F.round(F.least(F.lit(1.0), count * 0.20 + F.when(count > 0, 0.28).otherwise(0.0)), 4)


def reference_dependency(count: Column) -> Column:
    return F.round(F.least(F.lit(1.0), count * 0.18 + F.when(count > 0, 0.22).otherwise(0.0)), 4)


def enumeration_density(x: Column) -> Column:
    """.06 for each numeral, percentage, circled number and semicolon, 1 at most."""
    return F.round(F.least(F.lit(1.0), F.regexp_count(x, F.lit("[0-9]+|[①-⑳]|%|;|；")) * 0.06), 4)


def preview(x: Column, limit: int) -> Column:
    """White space squashed, cut to the limit with an ellipsis."""
    flat = strip(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def slug(x: Column) -> Column:
    """Path-safe name of at most 80 characters."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(strip(x), r'[\\/:*?"<>|]+', "_"), r"\s+", "_"), 1, 80)
    return F.when(safe == "", "untitled").otherwise(safe)


def age_days(at: Column, now: Column) -> Column:
    """Whole days between two instants, 0 at least; null for a null instant."""
    return F.greatest(F.lit(0), F.floor((now.cast("timestamp").cast("long") - at.cast("timestamp").cast("long")) / 86400))


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding that no binary representation of a tie can turn."""
    return F.round(x + 1e-9, places)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def closeness(x: Column, pivot: float, spread: float) -> Column:
    return clip(1 - F.least(F.lit(1.0), F.abs(x - pivot) / spread))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, x: acc + x)


def sums_before(sizes: Column, levels: int = 2) -> Column:
    """For each number of an array, the sum of those before it.

    Sums of runs of RUN numbers, summed up in the same way, leave less than RUN numbers to add for each
    place, so the work grows with the array; a fold that appends would copy what it has at every step.
    """
    if levels == 0:
        return F.transform(sizes, lambda x, i: _total(F.slice(sizes, 1, i)))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / RUN).cast("int"))
    runs = F.transform(starts, lambda k: _total(F.slice(sizes, k * RUN + 1, RUN)))
    # arrays in lambdas are named, so that they are worked out once
    return F.element_at(
        F.transform(
            F.array(runs),
            lambda r: F.element_at(
                F.transform(F.array(sums_before(r, levels - 1)), lambda heads: F.transform(sizes, lambda x, i: F.get(heads, F.floor(i / RUN).cast("int")) + _total(F.slice(sizes, i - i % RUN + 1, i % RUN)))), 1
            ),
        ),
        1,
    )


def top_entries(scores: Column, k: int) -> Column:
    """The k largest positive entries of a map as structs, by value descending, then key."""
    held = F.filter(F.map_entries(scores), lambda e: e["value"] > 0)
    order = F.transform(held, lambda e: F.struct((-e["value"]).alias("by"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(order), 1, k), lambda e: F.struct(e["key"], e["value"]))


def percentile_nearest(values: Column, percent: float) -> Column:
    """The value at index round-half-even(percent / 100 * (n - 1)) of a sorted array."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.rint((F.size(ordered) - 1) * (percent / 100)).cast("int"))


def percentile_audit(values: Column) -> Column:
    """The value at index int(.9 n) - 1 of a sorted array of ten or more, else null."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) >= 10, F.get(ordered, F.floor(F.size(ordered) * 0.9).cast("int") - 1))

"""Near-duplicate spans inside an article, merged to clusters with one survivor each.

Two spans are near duplicates if their normalised hashes are equal, one mostly contains the
other, their character 3-gram sets reach a Jaccard similarity, or their longest common
substring reaches a share of the shorter.  Clusters are closed under chains.  An article is
one row, so nothing is grouped across rows and work is bounded by the article.

Of all pairs in an article only those are compared whose gram sets can be alike by a bit map of each, or where
a part of one stands in the other that every common substring long enough must hold.  No link is lost by that;
the work still grows with the square of an article's different spans, but by little for each pair.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKS, PLAIN
from .walk import LONG, NEAR, alike

JACCARD, CONTAINED, SUBSTRING = 0.85, 0.8, 0.8
#: Length in characters that a survivor should be near to.
TARGET_LENGTH = 320
#: Bits of a map of grams, and the share of the grams of both that may differ in near sets.
BITS, APART = 1024, (1 - JACCARD) / (1 + JACCARD)
_AS_PLAIN, _MARKS = str.maketrans(MARKS, PLAIN), re.compile(f"[{MARKS}]")


def normal(text: str) -> str:
    """The text whose hash is ``text.normalised_hash``: no white space, plain marks."""
    return "".join((text.translate(_AS_PLAIN) if _MARKS.search(text) else text).split())


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring.

    Texts have a common substring of some length if they have one of any smaller length, so the
    length is found by halving; parts are compared by rolling hashes, and equal hashes by their text.
    """
    if len(a) > len(b):
        a, b = b, a
    least, most = 0, len(a)
    x, y = _points(a), _points(b)
    while least < most:
        size = (least + most + 1) // 2
        if _share(a, b, x, y, size):
            least = size
        else:
            most = size - 1
    return least


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of every part of ``size`` characters: sums over parts of doubling length, put together."""
    out, own, done, width = np.zeros(len(points) - size + 1, np.uint64), points * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), 0, 1
    with np.errstate(over="ignore"):
        while done < size:
            if size & width:
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[done : done + len(out)]
                done += width
            width *= 2
            half = width // 2
            if width <= size:
                own = (own[: len(own) - half] ^ (own[: len(own) - half] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + own[half:]
    return out


def _share(a: str, b: str, x: np.ndarray, y: np.ndarray, size: int) -> bool:
    """Whether two texts have a part of that length in common."""
    one, two = _hashes(x, size), _hashes(y, size)
    places = dict(zip(one[::-1].tolist(), range(len(one) - 1, -1, -1), strict=True))
    met = np.flatnonzero(np.isin(two, one)).tolist()
    return any(a[i : i + size] == b[j : j + size] for j in met for i in (places[int(two[j])],))


def grams(texts: Sequence[str]) -> tuple[list[frozenset[int]], list[int]]:
    """Of each text the set of its character 3-grams as numbers (a text no longer than one is its own), and a bit map of them."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    points = np.concatenate([_points("".join(texts)) + np.uint64(1), np.zeros(2, np.uint64)])
    numbers = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    whole = np.flatnonzero(np.arange(len(numbers)) < np.repeat(ends, sizes) - 2)
    bits = np.zeros((len(texts), BITS), bool)
    with np.errstate(over="ignore"):
        bits[np.repeat(np.arange(len(texts)), sizes)[whole], (numbers[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)] = True
    maps = [int.from_bytes(row) for row in np.packbits(bits, axis=1)]
    out, all_numbers = [], numbers.tolist()
    for k, (text, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        if len(text) < 3:  # an absent character is 0
            out.append(frozenset({sum((ord(c) + 1) << 42 - 21 * at for at, c in enumerate(text))} if text else ()))
            maps[k] = 1 if text else 0
        else:
            out.append(frozenset(all_numbers[end - len(text) : end - 2]))
    return out, maps


def near(a: str, b: str, x: frozenset[int], y: frozenset[int]) -> bool:
    """Whether two normal spans with gram sets x and y are near duplicates."""
    if a == b:
        return a != ""
    if len(a) > len(b):
        a, b, x, y = b, a, y, x
    if not a:
        return False
    if len(a) >= CONTAINED * len(b) and a in b:
        return True
    if min(len(x), len(y)) >= JACCARD * max(len(x), len(y)):
        common = len(x & y)
        if common >= JACCARD * (len(x) + len(y) - common):
            return True
    return _holds(a, b, _least(a))


def _least(text: str) -> int:
    """How long a substring must be that a span has in common with a longer one."""
    return math.ceil(SUBSTRING * len(text))


def parts(text: str) -> list[str]:
    """Parts of a span, end to end; a substring of the least length holds one of them, wherever it stands."""
    size = (_least(text) + 1) // 2
    return [text[i : i + size] for i in range(0, len(text) - size + 1, size)]


def _holds(a: str, b: str, least: int) -> bool:
    """Whether two texts have a substring of the least length in common: one of the parts of the first, with what is equal on either side of it."""
    at = 0
    for part in parts(a):
        end, place = at + len(part), b.find(part)
        while place >= 0:
            stop = place + len(part)
            before = _equal(min(at, place), lambda n: a[at - n : at] == b[place - n : place])  # noqa: B023  called at once
            if end - at + before + _equal(min(len(a) - end, len(b) - stop), lambda n: a[end : end + n] == b[stop : stop + n]) >= least:  # noqa: B023
                return True
            place = b.find(part, place + 1)
        at = end
    return False


def _equal(most: int, test: Callable[[int], bool]) -> int:
    """The largest number up to which a test holds that holds for all smaller ones too."""
    least = 0
    while least < most:
        n = (least + most + 1) // 2
        if test(n):
            least = n
        else:
            most = n - 1
    return least


def candidates(texts: Sequence[str], sets: Sequence[frozenset[int]], maps: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Places of pairs of different normal spans, among them all that are near duplicates.

    Bits that differ are at most as many as grams that do, and of near sets only a share of both differs.
    """
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    rows = [(j, texts[j], len(sets[j]), maps[j]) for j in order]
    for k, (i, text, size, own) in enumerate(rows):
        first, last = (ends := parts(text))[0], ends[-1]  # a third one would take a share below 2/3
        yield from ((i, j) for j, other, n, bits in rows[k + 1 :] if (own ^ bits).bit_count() <= APART * (size + n) + 1 or first in other or last in other)


def clusters(spans: list[str]) -> list[int]:
    """For each span the number of the first span of its cluster."""
    normals = [normal(x) for x in spans]
    first: dict[str, int] = {}
    for i, x in enumerate(normals):
        if x:
            first.setdefault(x, i)
    texts, place = list(first), {x: k for k, x in enumerate(first)}
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(texts) > 1:
        sets, maps = grams(texts)
        for i, j in candidates(texts, sets, maps):
            a, b = root(i), root(j)
            if a != b and near(texts[i], texts[j], sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
    return [first[texts[root(place[x])]] if x else i for i, x in enumerate(normals)]


def merge_spans(articles: DataFrame, target: int = TARGET_LENGTH) -> DataFrame:
    """(article_id, span, cluster, size, survivor) of (article_id, items array<string>[, ranks array<struct>]).

    The best span of a cluster survives, its others are variants of it.  Best is what has the
    least rank (``ranks``: for each item n_flags, gray, no_subtype and lost, which is minus the score
    of its family), then the length nearest to the target, then the first place.
    """
    rank = "struct<n_flags: int, gray: int, no_subtype: int, lost: double>"
    ranks = F.col("ranks") if "ranks" in articles.columns else F.lit(None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, items, given in zip(frame["article_id"], frame["items"], frame["ranks"], strict=True):
                items = list(items) if items is not None else []
                by = [tuple(r.values()) for r in given] if given is not None else [()] * len(items)
                members_of = defaultdict(list)
                for i, c in enumerate(clusters(items)):
                    members_of[c].append(i)
                for c, members in members_of.items():
                    best = min(members, key=lambda i: (by[i], abs(len(items[i]) - target), i))
                    out += [(key, i, c, len(members), i == best) for i in members]
            yield pd.DataFrame(out, columns=["article_id", "span", "cluster", "size", "survivor"])

    schema = "article_id bigint, span bigint, cluster bigint, size bigint, survivor boolean"
    return articles.select("article_id", "items", ranks.cast(f"array<{rank}>").alias("ranks")).mapInPandas(run, schema)


def sequence_similarity(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b: fingerprints, ...) with ``alike``: whether a is empty, equal to b, or both are long and their matching blocks make up most of them.

    Blocks are found from a's side, so a pair and its reverse can differ near the threshold.  The share of matching
    characters is at most that of the shorter in both, and that of the characters they have in common in any order;
    only pairs within the first bound leave the JVM, and only those within the second are matched.  Nulls count as empty.
    """

    def judged(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in frames:
            yield pd.Series([x is not None and alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    n, m = F.length(a), F.length(b)
    asked = (n >= LONG) & (m >= LONG) & (a != b) & (F.least(n, m) * 2 >= NEAR * (n + m))
    near = F.pandas_udf(judged, "boolean")(F.when(asked, a), F.when(asked, b))
    return pairs.withColumn("alike", (n == 0) | (a == b) | near)

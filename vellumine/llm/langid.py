"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of a letter n-gram is the product
(binding) of its letters' vectors, each rotated (permuted) by its place; a document's vector
is the sum (bundle) of the vectors of all its n-grams; a language's prototype is the sum over
the documents learnt from, each scaled to equal weight.  A document gets the language whose
prototype has the largest cosine with its vector.

Texts are lower-cased and every run of non-letters becomes one space.  Letters a to z and the
accented letters of ``ACCENTED`` have codes of their own; all other letters share the few codes
that are left, by code point, so that any script is accepted, but scripts other than Latin are
told apart only roughly.

``floors`` tells how alike a text of some size must be to its language: texts are put in classes by
the logarithm of their n-grams, and a class's floor is FLOOR of the middle score of the labelled
texts in it.  Repeated syllables, keyboard noise and scripts that nothing was learnt from stay
below.  Texts of fewer than LEAST n-grams have no floor, as a few letters tell too little.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties go to the
language first in alphabetical order; with nothing to learn from, every document is ``und``;
whole texts are read, whatever their length; repeated rows get equal results; an empty table
gives an empty result; other columns of the input are passed on, but those named lang_pred or
score give way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, ship

#: Dimensions of the vectors.
DIMENSIONS = 512
#: Letters of an n-gram.
N = 3
#: Codes of letters; 0 is the space.
CODES = 64
#: Seed of the random letter vectors.
SEED = 20240501
#: Part of the middle score of its size that a text must have, and n-grams from which that holds.
FLOOR, LEAST = 0.25, 64
#: Steps between 0 and 1 to which scores are counted for the middle one.
BINS = 1000
#: Documents multiplied at once, and n-grams of a sum.
ROWS = 64
GRAMS = 8192

# Accented letters of the Latin alphabet that have a code of their own.
ACCENTED = "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of each code point of the basic plane: 0 for whatever is no letter."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if not chr(c).isalpha():
            continue
        low = chr(c).lower()[0]
        if "a" <= low <= "z":
            table[c] = ord(low) - 96
        elif low in ACCENTED:
            table[c] = 27 + ACCENTED.index(low)
        else:
            table[c] = _shared_code(ord(low))
    return table


def _shared_code(point: int) -> int:
    first = 27 + len(ACCENTED)
    return first + point % (CODES - first)


@lru_cache(maxsize=1)
def placed_letters() -> list[np.ndarray]:
    """For each place in an n-gram, the rotated vectors of all letters."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CODES, DIMENSIONS))
    return [np.roll(letters, N - 1 - k, axis=1) for k in range(N)]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram, one row each: made when needed, as a table of all would be large."""
    out, rest = np.ones((len(grams), DIMENSIONS), np.int8), grams
    for letters in reversed(placed_letters()):
        rest, code = np.divmod(rest, CODES)
        out *= letters[code]
    return out.astype(np.float32)


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a text as numbers; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = letter_codes()
    codes = table[np.minimum(points, 0xFFFF)].astype(np.int64)
    far = points > 0xFFFF
    if far.any():
        codes[far] = [_shared_code(int(p)) if chr(p).isalpha() else 0 for p in points[far]]
    if not codes.any():
        return np.empty(0, np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]  # one space for a run
    if len(codes) < N:
        codes = np.concatenate((codes, [0] * (N - len(codes))))
    grams = codes[: len(codes) - N + 1]
    for k in range(1, N):
        grams = grams * CODES + codes[k : len(codes) - N + 1 + k]
    return grams


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the summed n-gram frequencies of a task's documents."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = gram_codes(text.as_py())
            if len(grams):
                if lang not in sums:
                    sums[lang] = np.zeros(CODES**N)
                own, times = np.unique(grams, return_counts=True)
                sums[lang][own] += times / np.sqrt(len(grams))
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        vector = sum(total[g].astype(np.float32) @ gram_vectors(g) for g in np.array_split(used, len(used) // GRAMS + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([vector.astype(float).tolist()], pa.list_(pa.float64()))], names=["lang", "part"]
        )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[float]]:
    """The prototype of each language, learnt from all rows of ``labelled``.

    Tasks send one vector per language; sums are grouped in Spark, and the driver receives as
    many vectors of DIMENSIONS numbers as there are languages.
    """
    ship(labelled.sparkSession)
    parts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    ).mapInArrow(_count, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).collect()
    return {r["lang"]: [x["x"] for x in r["v"]] for r in sorted(rows, key=lambda r: r["lang"])}


def _scores(texts: list[str | None], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many n-grams it has, and its cosines with the prototypes."""
    has = np.zeros(len(texts), np.int64)
    cosines = np.zeros((len(texts), len(prototypes)))
    for first in range(0, len(texts), ROWS):
        part = [gram_codes(text) for text in texts[first : first + ROWS]]
        sizes = np.array([len(grams) for grams in part])
        has[first : first + len(part)] = sizes
        used, at = np.unique(np.concatenate(part), return_inverse=True)
        row = np.repeat(np.arange(len(part)), sizes)
        counts = np.bincount(row * len(used) + at, minlength=len(part) * len(used)).reshape(len(part), len(used)).astype(np.float32)
        bundle = counts @ gram_vectors(used)
        size = np.linalg.norm(bundle, axis=1)
        size[size == 0] = 1
        cosines[first : first + len(part)] = (bundle @ prototypes.T) / size[:, None]
    return has, cosines


def predict(docs: DataFrame, model: dict[str, list[float]], text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred and score and, if named, the number of n-grams."""
    ship(docs.sparkSession)
    names = list(model)
    own = ["lang_pred", "score", *([size_col] if size_col else [])]
    kept = [c for c in docs.columns if c != text_col and c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = np.array([model[k] for k in names], np.float32).reshape(len(names), DIMENSIONS)
        if names:
            prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1), 1e-12)[:, None]
        for batch in batches:
            lang, score, sizes = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if names and batch.num_rows:
                sizes, cosines = _scores(batch.column(len(kept)).to_pylist(), prototypes)
                has = sizes > 0
                best = cosines.argmax(axis=1)
                lang[has] = np.array(names, object)[best[has]]
                score[has] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[has]
            columns = [batch.column(i) for i in range(len(kept))]
            found = [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *found[: len(own)]], names=[*kept, *own])
        give_back()

    fields = [docs.schema[c] for c in kept]
    found = [T.StructField(n, kind) for n, kind in zip(own, (T.StringType(), T.DoubleType(), T.LongType()), strict=False)]
    schema = T.StructType([*fields, *found])
    return docs.select(*kept, F.col(text_col).cast("string")).mapInArrow(run, schema)


def size_class(size: Column) -> Column:
    """The class of a number of n-grams: its binary logarithm."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def floors(scored: DataFrame, score_col: str = "score", size_col: str = "size") -> dict[int, float]:
    """The least score of each class of sizes, from scored texts of known language.

    Scores are counted to BINS steps in Spark; the driver receives these counts of at most 64 classes.
    """
    step = F.floor(F.col(score_col) * BINS).cast("int")
    rows = scored.where(F.col(size_col) >= LEAST).groupBy(size_class(F.col(size_col)).alias("k"), step.alias("step")).count().collect()
    out = {}
    for k in {r.k for r in rows}:
        counts = sorted((r.step, r["count"]) for r in rows if r.k == k)
        half, seen = sum(n for _, n in counts) / 2, 0
        for at, n in counts:
            seen += n
            if seen >= half:
                out[k] = FLOOR * at / BINS
                break
    return out


def alike(least: dict[int, float], score: Column, size: Column) -> Column:
    """Whether a score isn't below the floor of its size; sizes without a floor always pass."""
    floor = F.lit(0.0)
    for k, x in sorted(least.items()):
        floor = F.when(size_class(size) == k, F.lit(x)).otherwise(floor)
    return (size < LEAST) | (score >= floor)

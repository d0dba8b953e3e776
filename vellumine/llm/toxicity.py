"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words, and the beginnings of longer words (which keep what inflected
and newly made forms share), each hashed to one of BINS numbers.
The score of a text is

    sigmoid(bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>)

over its terms.  The second sum lets two terms mean more, or less, together than each alone (an
insult beside a mention of a group), which a sum of weights can't express.  It takes linear
time: half of (the square of the summed vectors minus the summed squares), for each factor.

Weights are learnt by FTRL with an L1 penalty, so that terms without a bearing keep exactly 0.
Vectors are learnt by AdaGrad, for a term from when its weight is no longer 0 (vectors that adapt
to their terms, as in the published DiFacto); others have none, so that the thousands of terms of
a long text add no noise.  A pair of terms of which neither alone says anything is therefore not
learnt.  Left out are terms that stand in fewer than MIN_TEXTS of the texts learnt from, and those
whose texts have label 1 about as often as all texts: within CHANCE standard deviations.  Without
this the thousands of terms of a long text add up to what no term means.

Learning takes at most TRAIN_ROWS labelled texts, those with the smallest hashes of identifier and
text, and rows equal in these and the label once; it runs in one task over their terms, which BINS and TRAIN_ROWS bound.  Everything else
(terms of all texts, scores) is done where the rows are; the driver sees only the model, at most
BINS rows of 1 + FACTORS numbers.

Edge cases: null and empty texts, and texts without a word, score by the bias alone; without
labelled rows, or with one label only, every text has the share of label 1 (0.0 if there are
none); a label other than 1 counts as 0, a null label is no label; labels that disagree for one
identifier each count; repeated rows have equal scores; whole texts are read; an empty table
gives an empty result; further columns are passed on, but those named score and predicted give way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, shared_root, ship, small_or_shuffled

#: Numbers that terms are hashed to.
BINS = 1 << 20
#: Factors of a term's vector.
FACTORS = 8
#: Most labelled texts that are learnt from.
TRAIN_ROWS = 20_000
#: How many times as many rows are looked at, so that not too few are left.
SPARE = 1.3
#: Texts, of those learnt from, that a term must stand in.
MIN_TEXTS = 4
#: Standard deviations by which the label must differ on the texts of a term.
CHANCE = 4.5
#: Lengths of beginnings that are terms, of words that are longer.
STEMS = (4, 6)
#: Passes over the texts, texts of a step.
PASSES = 12
STEP = 128
#: FTRL: rate, smoothing, L1, L2; rate, L2 and first size of vectors.
RATE, SMOOTH, L1, L2 = 0.15, 1.0, 1.5, 1.0
V_RATE, V_L2, V_SIZE = 0.03, 0.02, 0.01
SEED = 20240617
#: Words whose terms a worker remembers.
REMEMBERED = 300_000

WORD = re.compile(r"[^\W\d_]+")
_known: dict[str, tuple[int, ...]] = {}


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) % BINS


def _word_terms(word: str) -> tuple[int, ...]:
    """The terms of one word: itself and its beginnings."""
    found = _known.get(word)
    if found is None:
        if len(_known) >= REMEMBERED:
            _known.clear()
        plain = unicodedata.normalize("NFKC", word.casefold())
        found = _known[word] = (_hash(f"w {plain}"), *(_hash(f"s {plain[:k]}") for k in STEMS if len(plain) > k))
    return found


def terms(text: str | None) -> np.ndarray:
    """The distinct terms of a text, as sorted numbers."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.int64)
    each = [_word_terms(w) for w in words]
    return np.unique(np.fromiter((i for t in set(each) for i in t), np.int64))


def _sums(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows' parts; rows may be empty."""
    out = np.zeros((len(sizes), *x.shape[1:]), x.dtype)
    if len(x):
        out[sizes > 0] = np.add.reduceat(x, starts[sizes > 0])
    return out


class Machine:
    """The factorization machine: terms that have a weight, the weights, the vectors and the bias."""

    def __init__(self, bias: float, bins: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.bias, self.bins, self.weights, self.vectors = bias, bins, weights, vectors
        self.at = np.full(BINS, -1, np.int32)
        self.at[bins] = np.arange(len(bins))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1 for rows of terms."""
        return 1 / (1 + np.exp(-self.margins([(at := self.at[r])[at >= 0] for r in rows])))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """As scores, before the sigmoid, for rows of places in ``bins``."""
        sizes = np.array([len(r) for r in rows], np.int64)
        at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        v = self.vectors[at]
        pairs = ((_sums(v, starts, sizes) ** 2 - _sums(v * v, starts, sizes)).sum(axis=1)) / 2
        return np.clip(self.bias + _sums(self.weights[at], starts, sizes) + pairs, -30, 30)


def learn(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS) -> Machine:
    """A machine for rows of terms with their labels (0 or 1), in the order given."""
    share = float(labels.mean()) if len(labels) else 0.0
    nothing = np.empty(0, np.int64)
    if not 0 < share < 1:
        return Machine(30.0 if share else -30.0, nothing, np.empty(0), np.empty((0, factors)))
    every = np.concatenate([*rows, nothing])
    count = np.bincount(every, minlength=BINS)
    surplus = np.bincount(every, np.repeat(labels - share, [len(r) for r in rows]), BINS)
    bins = np.flatnonzero((count >= MIN_TEXTS) & (np.abs(surplus) > CHANCE * np.sqrt(count * share * (1 - share))))
    place = np.full(BINS, -1, np.int64)
    place[bins] = np.arange(len(bins))
    rows = [(at := place[r])[at >= 0] for r in rows]
    rng = np.random.default_rng(SEED)
    z, n, w = np.zeros(len(bins)), np.zeros(len(bins)), np.zeros(len(bins))
    first = rng.normal(0, V_SIZE, (len(bins), factors))
    v, g2 = np.zeros((len(bins), factors)), np.zeros((len(bins), factors))
    bias, b2 = float(np.log(share / (1 - share))), 1.0
    machine = Machine(bias, nothing, w, v)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), STEP):
            chosen = [rows[i] for i in order[k : k + STEP]]
            y = labels[order[k : k + STEP]]
            machine.bias, machine.weights, machine.vectors = bias, w, v
            error = 1 / (1 + np.exp(-machine.margins(chosen))) - y
            b2 += error.mean() ** 2
            bias -= 0.1 * error.mean() / np.sqrt(b2)
            sizes = np.array([len(r) for r in chosen])
            at, row = np.concatenate([*chosen, nothing]), np.repeat(np.arange(len(chosen)), sizes)
            used, own = np.unique(at, return_inverse=True)
            g = np.bincount(own, error[row], len(used))
            # weights
            before = np.sqrt(n[used])
            n[used] += g * g
            z[used] += g - (np.sqrt(n[used]) - before) / RATE * w[used]
            w_new = -(z[used] - np.sign(z[used]) * L1) / ((SMOOTH + np.sqrt(n[used])) / RATE + L2)
            w[used] = np.where(np.abs(z[used]) <= L1, 0.0, w_new)
            # vectors of terms that have a weight; one that loses it is put aside
            live = w[used] != 0
            new = used[live & ~v[used].any(axis=1)]
            v[new] = first[new]
            v[used[~live]] = 0
            sums = _sums(v[at], np.cumsum(sizes) - sizes, sizes)
            held = live[own]
            if held.any():
                part = error[row[held], None] * (sums[row[held]] - v[at[held]])
                gv = np.zeros((len(used), factors))
                np.add.at(gv, own[held], part)
                gv = gv[live] + V_L2 * v[used[live]]
                g2[used[live]] += gv * gv
                v[used[live]] -= V_RATE * gv / np.sqrt(1 + g2[used[live]])
    kept = w != 0
    return Machine(bias, bins[kept], w[kept], v[kept])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, text) to (place, label, terms)."""
    for batch in batches:
        found = [terms(text.as_py()).astype(np.int32) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["place", "label", "terms"])
    give_back()


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of terms, in one task, to the model: the bias as number -1, then the terms."""
    rows, labels = [], []
    for batch in batches:
        rows += [np.asarray(x.values, np.int64) for x in batch.column(2)]
        labels += batch.column(1).to_pylist()
    m = learn(rows, np.array(labels, float))
    bins, weights = [-1, *m.bins.tolist()], [m.bias, *m.weights.tolist()]
    vectors = [[0.0] * FACTORS, *m.vectors.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(weights, pa.float64()), pa.array(vectors, pa.list_(pa.float64()))], names=["bin", "weight", "vector"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Learn from the documents that have a label; at most ``rows`` of them, chosen by hash."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("label")).distinct()
    known = small_or_shuffled(materialise(known, f"{shared_root(spark)}/labels"))
    place = F.xxhash64("id", F.col("text"))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")
    # the part of all hashes below which there are enough rows, so that no task meets more than a few times ``rows``
    part = min(1.0, SPARE * rows / max(1, chosen.count()))
    chosen = chosen.select(place.alias("place"), "label", "text").where(F.col("place") < F.lit(-(2.0**63) + part * 2.0**64))
    found = chosen.mapInArrow(_term_rows, "place bigint, label int, terms array<int>").dropDuplicates(["place", "label"])
    model = found.orderBy("place", "label", "terms").limit(rows).coalesce(1).mapInArrow(_fit_rows, "bin int, weight double, vector array<double>")
    model = materialise(model, f"{shared_root(spark)}/model").toPandas().sort_values("bin")
    if not len(model):
        return learn([], np.empty(0))
    vectors = np.array(model.vector.tolist()[1:], float).reshape(len(model) - 1, FACTORS)
    return Machine(float(model.weight.iloc[0]), model.bin.to_numpy()[1:], model.weight.to_numpy()[1:], vectors)


def predict(docs: DataFrame, model: Machine, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with score and predicted."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model.bias, model.bins, model.weights, model.vectors))
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*sent.value)
        for batch in batches:
            scores = machine.scores([terms(text.as_py()) for text in batch.column(len(kept))])
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])
        give_back()

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*kept, F.col(text_col).cast("string")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: those whose crc32 of the identifier leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

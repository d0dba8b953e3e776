"""Mixing documents to target domain weights, with DataFrame functions only.

1. Domains come from the table of labels: ``toxic``, else ``high`` or ``low`` quality.  Two
   naive Bayes classifiers (toxic or not, low quality or not, the posterior of a domain being
   the product) over the presence of words and word endings are fitted on one half of a
   bounded sample of labelled documents (``TRAIN_ROWS``, the smallest hashes of the
   identifier; equal texts count once).  Its features are those of the largest likelihood
   ratio statistics, ``MIN_G2`` at least and ``MAX_FEATURES`` of them at most; log odds are
   clipped to 0 and ``MAX_ODDS`` and rounded to 1 / ``SCALE``.  A feature is one number, the
   high 48 bits of its hash and its two log odds, which stands in an array at a place given by
   the low bits of the hash; so one look-up tells whether a word is a feature and what it adds.
   The other half of the sample sets the temperatures and shifts that make the posteriors honest.
2. Every document gets posteriors p_k: soft memberships.  This table, written out once, is all
   that the following steps and the result read: texts are classified a single time.
3. Rates r >= 0 are fitted by projected gradient steps on least squares: with n the tokens of
   a document and T those of the corpus, sum(r * n * p_k) shall be T * target_k.  Residuals e
   are weighted by the inverse Gram matrix M of the memberships of documents with a rate above
   0, in which the problem is well conditioned and a few steps do; a pull towards rate 1 (``PULL``) makes the solution unique.  A step is
   r <- max(0, r - (p . M^-1 e + PULL * (r - 1)) / (1 + PULL)).  As a rate follows from the
   document's memberships and the residuals so far, a step costs one sum over the documents;
   only the K sums reach the driver.  The residuals that remain are logged, and ``shares_of``
   gives them as a table: where the classifier can tell no document free of a domain, that
   domain's target can lie below what any rates reach.

Edge cases: a null or empty text has no tokens, the prior as posteriors, and the rate these
give; labels that are null or belong to no document are ignored, repeated labels count once
(the largest); without labels all documents are ``high`` alike; repeated rows get equal
rates; an empty table gives an empty result; targets are scaled to sum to 1; other columns of
the input are passed on, but those named like a column of the result give way to it
(``resample`` passes on all of them).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_root

#: Domains in order.
DOMAINS = ("high", "low", "toxic")
TRAITS = ("low", "toxic")
#: Target shares of tokens.
TARGETS = {"high": 0.84, "low": 0.11, "toxic": 0.05}
#: Labelled documents that are used, at most; half to fit, half to set the temperature.
TRAIN_ROWS = 10_000
#: Partitions of the sample at most.
SAMPLE_PARTS = 16
#: Features of the classifier at most, and places of the array they stand in, a power of two.
MAX_FEATURES = 4096
PLACES = 1 << 15
#: Least likelihood ratio statistic of a feature, and largest log odds and their steps per unit.
MIN_G2 = 25.0
MAX_ODDS = 4.0
SCALE = 60
#: Pull towards rate 1, and gradient steps at most.
PULL = 1e-3
STEPS = 30
TOLERANCE = 1e-6
TEMPERATURES = tuple(2.0**k for k in range(6))
SHIFTS = tuple(float(-k) for k in range(-1, 6))
#: Columns of the result beside those of the input.
ADDED = ("n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Model:
    """The features by place, and for each trait the prior log odds and the temperature."""

    table: tuple[int, ...]
    prior: tuple[float, ...]
    temperatures: tuple[float, ...]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+"), lambda w: w != "")


def _word_hash(w: Column) -> Column:
    return F.xxhash64(F.lower(F.rtrim(w, F.lit(".,;:"))))


def _ending(w: Column) -> Column:
    return F.substring(w, -2, 2)


def _ending_hash(ending: Column) -> Column:
    return F.xxhash64(F.lit("ending"), ending)


def _constants(values: tuple[int, ...]) -> Column:
    """A constant array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<bigint>")


def _packed(h: int, odds: Sequence[int]) -> int:
    """A feature as one number: the high bits of its hash, then each trait's log odds."""
    low, toxic = odds
    return (h >> 16 << 16) | (low << 8) | toxic


def found_features(words: Column, model: Model) -> Column:
    """The model's features that a document has, each once; ``words`` may be its distinct ones."""
    table = _constants(model.table)

    def hit(h: Column) -> Column:
        t = F.get(table, h.bitwiseAND(F.lit(PLACES - 1)).cast("int"))
        return F.when(F.shiftright(h.bitwiseXOR(t), 16) == 0, t)

    # an expression is worked out wherever it stands, so each hash is made in one array and looked up in the next
    endings = F.array_distinct(F.transform(words, _ending))
    hits = (F.transform(F.transform(x, of), hit) for x, of in ((words, _word_hash), (endings, _ending_hash)))
    return F.array_distinct(F.concat(*(F.filter(x, lambda t: t.isNotNull()) for x in hits)))


def _evidence(features: Column) -> Column:
    """What the features add to the log odds: that of the first trait in the high 32 bits, of the second in the low."""
    low, toxic = F.lit(0xFF00), F.lit(0xFF)
    return F.aggregate(features, F.lit(0).cast("bigint"), lambda acc, f: acc + F.shiftleft(f.bitwiseAND(low), 24) + f.bitwiseAND(toxic))


def _of_trait(evidence: Column, k: int) -> Column:
    part = F.shiftright(evidence, 32) if k == 0 else evidence.bitwiseAND(F.lit(0xFFFFFFFF))
    return part.cast("double") / SCALE


def _trait(evidence: Column, prior: Column, temperature: Column) -> Column:
    """The posterior of a trait."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), prior + evidence / temperature))))


def _posteriors(evidence: Column, model: Model) -> list[Column]:
    """The posteriors of the domains, in order."""
    low, toxic = (_trait(_of_trait(evidence, k), F.lit(model.prior[k]), F.lit(model.temperatures[k])) for k in range(len(TRAITS)))
    return [(1.0 - toxic) * (1.0 - low), (1.0 - toxic) * low, toxic]


def _g2(own: Column, n_own: int, base: Column, n_base: int) -> Column:
    """Likelihood ratio statistic of a feature's presence in two domains."""
    share = (own + base) / float(max(1, n_own + n_base))

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    return 2 * (
        part(own, share * n_own)
        + part(base, share * n_base)
        + part(n_own - own, (1 - share) * n_own)
        + part(n_base - base, (1 - share) * n_base)
    )


def fit_classifier(docs: DataFrame, labels: DataFrame, home: str, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("toxic"), (F.min("quality") == 0).alias("low"), F.xxhash64("doc_id").alias("lot")
    )
    picked = materialise(known.orderBy("lot").limit(rows), f"{home}/labelled")
    # at most TRAIN_ROWS rows, by the limit above
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.struct("lot", *TRAITS, words_of(F.col("text")).alias("words")).alias("x")
    )
    sample = sample.groupBy("sha").agg(F.min("x").alias("x")).select(*(f"x.{t}" for t in TRAITS), (F.pmod("x.lot", F.lit(2)) == 0).alias("fits"), "x.words")
    # bounded like its rows, not by the partitions of the session: each file that is written costs a task and its folders
    sample = materialise(sample.coalesce(SAMPLE_PARTS), f"{home}/sample")
    fits = sample.where("fits")
    sizes = fits.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(t).alias(t) for t in TRAITS)).first()
    n = sizes["n"]
    hashes = F.array_distinct(F.concat(F.transform("words", _word_hash), F.transform("words", lambda w: _ending_hash(_ending(w)))))
    counts = fits.select(*TRAITS, F.explode(hashes).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).cast("double").alias("all"), *(F.count_if(t).cast("double").alias(t) for t in TRAITS)
    )
    g2 = [_g2(F.col(t), sizes[t], F.col("all") - F.col(t), n - sizes[t]) for t in TRAITS]
    counts = counts.select("*", *(x.alias(f"g_{t}") for x, t in zip(g2, TRAITS, strict=True)))
    strongest = F.greatest(*(f"g_{t}" for t in TRAITS))
    # at most MAX_FEATURES rows
    best = counts.where(strongest >= MIN_G2).orderBy(F.desc(strongest), "h").limit(MAX_FEATURES).collect()
    places = [0] * PLACES
    for r in reversed(best):  # where two share a place the stronger stays
        odds = []
        for t in TRAITS:
            x = math.log((r[t] + 0.5) / (sizes[t] + 1)) - math.log((r["all"] - r[t] + 0.5) / (n - sizes[t] + 1))
            # words that are rarer with the trait mostly tell that a text is long
            odds.append(round(SCALE * max(0.0, min(MAX_ODDS, x))) if r[f"g_{t}"] >= MIN_G2 else 0)
        places[r["h"] % PLACES] = _packed(r["h"], odds)
    prior = tuple(math.log((sizes[t] + 1) / (n - sizes[t] + 1)) for t in TRAITS)
    model = Model(tuple(places), prior, (1.0,) * len(TRAITS))
    # the temperatures and shifts of least log loss on the half that wasn't fitted on
    rest = sample.where("not fits").select(*TRAITS, _evidence(found_features(F.col("words"), model)).alias("z"))
    rest = materialise(rest.coalesce(SAMPLE_PARTS), f"{home}/rest")
    cases = F.array(*(F.struct(F.lit(k).alias("k"), F.col(t).alias("has"), _of_trait(F.col("z"), k).alias("z"), F.lit(prior[k]).alias("prior")) for k, t in enumerate(TRAITS)))
    grid = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(shift).alias("shift")) for x in TEMPERATURES for shift in SHIFTS))
    tried = rest.select(F.explode(cases).alias("c"), grid.alias("g")).select("c", F.explode("g").alias("g"))
    p = _trait(F.col("c.z"), F.col("c.prior") + F.col("g.shift"), F.col("g.x"))
    losses = tried.groupBy("c.k", "g.x", "g.shift").agg(F.sum(-F.log(F.when(F.col("c.has"), p).otherwise(1.0 - p))).alias("loss"))
    chosen = {k: (1.0, 0.0) for k in range(len(TRAITS))}
    # a row for each trait and point of the grid
    for r in sorted(losses.collect(), key=lambda r: (-r["loss"], r["x"], r["shift"])):
        chosen[r["k"]] = (r["x"], r["shift"])
    shifted = tuple(prior[k] + chosen[k][1] for k in range(len(TRAITS)))
    return Model(model.table, shifted, tuple(chosen[k][0] for k in range(len(TRAITS))))


def with_posteriors(docs: DataFrame, model: Model, text_col: str = "text", passed: Sequence[str] = ()) -> DataFrame:
    """n_tokens and p_<domain> of every row, with the columns ``passed`` of ``docs``."""
    scored = docs.select(*passed, words_of(F.col(text_col)).alias("__x_words"))
    scored = scored.select(*passed, F.size("__x_words").cast("bigint").alias("n_tokens"), F.array_distinct("__x_words").alias("__x_words"))
    scored = scored.select(*passed, "n_tokens", _evidence(found_features(F.col("__x_words"), model)).alias("__x_z"))
    names = [f"p_{d}" for d in DOMAINS]
    return scored.select(*passed, "n_tokens", *(p.alias(n) for p, n in zip(_posteriors(F.col("__x_z"), model), names, strict=True)))


def rate_column(history: list[np.ndarray]) -> Column:
    """The rate of a document after the steps of ``history``, each M^-1 e."""
    if not history:
        return F.lit(1.0)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    steps = F.array(*(F.struct(*(F.lit(float(x)).alias(d) for x, d in zip(u, DOMAINS, strict=True))) for u in history))

    def step(rate: Column, u: Column) -> Column:
        pushed = sum((p[k] * u[d] for k, d in enumerate(DOMAINS[1:], 1)), p[0] * u[DOMAINS[0]])
        return F.greatest(F.lit(0.0), rate - (pushed + PULL * (rate - 1.0)) / (1.0 + PULL))

    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(shares: DataFrame, targets: dict[str, float] = TARGETS) -> list[np.ndarray]:
    """M^-1 e of each projected gradient step, over a materialised table of shares."""
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = wanted / wanted.sum()
    size = len(DOMAINS)
    n, r, p = F.col("n_tokens"), F.col("r"), [F.col(f"p_{d}") for d in DOMAINS]
    sums = [n, *(n * r * x for x in p), *(F.when(r > 0, n * x * y).otherwise(0.0) for x in p for y in p)]
    history: list[np.ndarray] = []
    before = None
    for _ in range(STEPS):
        row = shares.withColumn("r", rate_column(history)).agg(*(F.sum(x).alias(f"x{i}") for i, x in enumerate(sums))).first()
        total = float(row[0] or 0)
        if total == 0:
            return []
        e = np.array([float(x) for x in row[1 : 1 + size]]) / total - wanted
        if before is not None and np.abs(e - before).max() < TOLERANCE:
            break
        before = e
        log.info("step %d: residuals %s", len(history), dict(zip(DOMAINS, e.round(6).tolist(), strict=True)))
        gram = np.array([float(x) for x in row[1 + size :]]).reshape(size, size) / total
        history.append(np.linalg.solve(gram + 1e-9 * np.eye(size), e))
    return history


def shares_of(mixed: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, target, share and residual (share - target) of the tokens that the rates of ``mixed`` give."""
    whole = sum(targets.get(d, 0.0) for d in DOMAINS)
    total = F.sum("n_tokens").alias("total")
    sums = mixed.agg(total, *(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in DOMAINS))
    rows = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(targets.get(d, 0.0) / whole).alias("target"), (F.col(d) / F.col("total")).alias("share")) for d in DOMAINS))
    return sums.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.share") - F.col("x.target")).alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, passed: Sequence[str] | None = None) -> DataFrame:
    """n_tokens, p_<domain>, rate and copies of every row, with its columns ``passed`` (all, if not given).

    copies is floor(rate + u) with u uniform by the document's identifier and text, so the
    expected number of copies is the rate and a run can be repeated.
    """
    home = shared_root(docs.sparkSession)
    model = fit_classifier(docs, labels, home)
    passed = [c for c in (docs.columns if passed is None else passed) if c not in ADDED]
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    scored = with_posteriors(docs.withColumn("__x_u", u), model, passed=[*passed, "__x_u"])
    scored = materialise(scored, f"{home}/scored")
    rated = scored.withColumn("rate", rate_column(fit_rates(scored.select("n_tokens", *(f"p_{d}" for d in DOMAINS)), targets)))
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col("__x_u")).cast("bigint")).select(*passed, *ADDED)


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs`` as the fitted rates have them: each appears ``copies`` times.

    The expected number of copies is the rate, so the expected tokens of the domains are those
    that the rates were fitted to.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__x_row"))
    mixed = mix(whole, labels, targets, ["__x_row"]).where("copies > 0")
    return mixed.select("__x_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("__x_row.*")

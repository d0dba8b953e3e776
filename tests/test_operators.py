"""Text scalars, folds and selections against plain Python on small inputs."""

import random
import re
from collections import Counter, deque
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from vellumine.functions import lexicon as L
from vellumine.functions import text as T
from vellumine.operators import dedupe, feedback, pool, profile, review, segment
from vellumine.plans import catalogue
from vellumine.streaming import state


def test_chinese_pack_counts_anywhere(spark):
    row = spark.createDataFrame([("zh", "总之如此。可见一斑。"), ("en", "So it is, and also so on.")], "lang string, text string")
    hay = T.haystack(F.col("text"), F.col("lang"))
    out = [r[0] for r in row.select(L.occurrences(hay, F.col("lang"), "summary")).collect()]
    assert out == [2, 2]  # "also" holds no whole word "so"


def test_strength_and_fit(spark):
    got = spark.range(4).select(T.marker_strength(F.col("id").cast("int"))).collect()
    assert [r[0] for r in got] == [0.0, 0.48, 0.66, 0.84]


def test_sentences_and_windows(spark):
    rows = spark.createDataFrame([(1, "en", "One. Two! Three?\nFour"), (2, "zh", "甲。乙！丙\n\n丁"), (3, "en", None), (4, "en", "")], "article_id long, lang string, text string")
    cut = {r.article_id: (len(r.paras), list(r.sents)) for r in segment.units(rows).collect()}
    assert cut[1] == (2, ["One.", "Two!", "Three?", "Four"])
    assert cut[2] == (2, ["甲。", "乙！", "丙", "丁"])
    assert cut[3] == cut[4] == (0, [])
    sizes = [(r.start, r.size) for r in segment.sentence_windows(rows.where("article_id = 1")).collect()]
    assert sorted(sizes) == [(0, 3), (0, 4), (1, 3)]


def test_jaccard_and_containment(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("ab", "ab"), ("", ""), ("abcdefghij", "abcdefgh")], "a string, b string")
    got = df.select(T.jaccard(T.shingles(F.col("a")), T.shingles(F.col("b"))), T.contains_mostly(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 4) for r in got] == [0.3333, 1.0, 0.0, 0.75]
    assert [r[1] for r in got] == [False, True, False, True]


def test_percentiles(spark):
    df = spark.createDataFrame([([float(x) for x in range(1, 11)],), ([3.0, 1.0],), ([],)], "v array<double>")
    got = df.select(T.percentile_nearest(F.col("v"), 50), T.percentile_audit(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(5.0, 9.0), (1.0, None), (None, None)]


def test_clusters_chain():
    spans = ["abcdefghijklmnop qrst", "abcdefghijklmnop qrs", "other words here", "abcdefghijklmnop qr", ""]
    assert dedupe.clusters(spans) == [0, 0, 2, 0, 4]
    random.seed(5)
    for _ in range(200):
        a, b = ("".join(random.choice("ab") for _ in range(random.randint(0, 12))) for _ in "ab")
        table = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
        assert dedupe.longest_common(a, b) == max(map(len, table), default=0)


def _near(a, b):
    """By definition: equal, alike in 3-grams, or with a common substring of most of the shorter."""
    x, y = ({t} if len(t) <= 3 else {t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    shorter = min(len(a), len(b))
    return a != "" != b and (len(x & y) >= dedupe.JACCARD * len(x | y) or dedupe.longest_common(a, b) >= dedupe.SUBSTRING * shorter)


def test_clusters_against_all_pairs():
    """On spans that are edited copies, from few characters and from many."""
    rng, merged = random.Random(3), 0
    for _ in range(60):
        alphabet = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz字数。， "])
        pool = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 20, 80, 200]))) for _ in range(6)]
        spans = []
        for x in rng.choices(pool, k=25):
            at, gone = rng.randint(0, len(x)), rng.choice([0, 1, 3, len(x) // 5])
            spans.append(x[:at] + "".join(rng.choices(alphabet, k=rng.choice([0, 1, 4]))) + x[at + gone :])
        plain, of = [dedupe.normal(x) for x in spans], list(range(25))
        for i, j in combinations(range(25), 2):
            if of[i] != of[j] and _near(plain[i], plain[j]):
                of = [min(of[i], of[j]) if c in (of[i], of[j]) else c for c in of]
        assert dedupe.clusters(spans) == of
        merged += sum(i != c for i, c in enumerate(of))
    assert merged > 300


def test_few_pairs_of_long_articles_are_compared(monkeypatch):
    rng, asked, near = random.Random(4), [], dedupe.near
    monkeypatch.setattr(dedupe, "near", lambda *pair: asked.append(1) or near(*pair))
    spans = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(600)]
    assert dedupe.clusters(spans + [spans[0][:-1]]) == [*range(600), 0]
    assert len(asked) < 6000  # of 180,300 pairs


def test_articles_of_one_file_are_dealt_out(spark):
    assert "Exchange hashpartitioning(article_id" in catalogue.near_duplicate_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_limiter_ignores_denied_hits(spark):
    rows = [(i, k, float(at)) for i, (k, at) in enumerate([("a", 0), ("a", 1), ("a", 2), ("a", 50), ("a", 61), ("b", 5)])]
    got = {r.event_id: r.allowed for r in state.rate_limit(spark.createDataFrame(rows, "event_id long, key string, at double"), 60.0, 2).collect()}
    seen, expected = {}, {}
    for i, k, at in rows:
        expected[i] = state.admit(seen.setdefault(k, deque()), at, 60.0, 2)
    assert got == expected and got[3] is False and got[4] is True


def test_limiter_as_a_stream(spark, tmp_path):
    rows = [(i, "a", float(at)) for i, at in enumerate([0, 1, 2, 61])]
    spark.createDataFrame(rows, "event_id long, key string, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, key string, at double").parquet(str(tmp_path / "in"))
    run = state.rate_limit_stream(source, 60.0, 2).writeStream.format("memory").queryName("limited").outputMode("append")
    run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True}


def test_feedback_states(spark):
    rows = [(1, i, True) for i in range(3)] + [(2, i, False) for i in range(3)] + [(3, 0, True)]
    got = {r.key: r.status for r in state.feedback_fold(spark.createDataFrame(rows, "key long, seq long, ok boolean")).collect()}
    assert got == {1: "promoted", 2: "deprecated", 3: "gray"}


def test_diverse_selection_quotas(spark):
    rows = [("q", i, f"a{i % 4}", f"s{i % 2}", float(100 - i)) for i in range(12)]
    got = pool.diverse(spark.createDataFrame(rows, "q string, candidate_id long, article_id string, source string, score double"), "q", 6).collect()
    picked = [r.candidate_id for r in sorted(got, key=lambda r: r.place)]
    assert picked == [0, 1, 2, 3, 4, 5]  # four by quota, the rest filled by score


def select_by_force(rows, limit):
    """The reference's selection in plain Python; rows are (id, article, source, card, score, text)."""
    quotas = [(1, max(1, limit // 3), max(1, limit // 4)), (2, max(2, limit // 2), max(2, limit // 3)), (3, limit, limit), (10**9,) * 3]
    picked, prints, counts = [], [], [Counter(), Counter(), Counter()]
    for quota in quotas:
        for row in sorted(rows, key=lambda r: (-r[4], r[0])):
            mark = re.sub(r"[^0-9A-Za-z\u4e00-\u9fff]+", "", row[5])[:500]
            near = any(mark == p or (min(len(mark), len(p)) >= 80 and SequenceMatcher(None, mark, p).ratio() >= 0.92) for p in prints)
            if len(picked) >= limit or row[0] in picked or not mark or near:
                continue
            if any(g and c[g] >= q for c, g, q in zip(counts, row[1:4], quota, strict=True)):
                continue
            picked.append(row[0])
            prints.append(mark)
            for c, g in zip(counts, row[1:4], strict=True):
                c[g] += 1
    return picked


def test_diverse_selection_looks_beyond_a_hot_source(spark):
    random.seed(6)
    words = lambda: " ".join(random.choice("abcdefghij") * random.randint(2, 9) for _ in range(60))
    copied = words()
    hot = [(i, "a-hot", "s-hot", f"c{i % 2}", 1000.0 - i, copied + f" {i}" if i % 3 else words()) for i in range(300)]
    rest = [(1000 + i, f"a{i % 9}", f"s{i % 5}", f"c{i % 4}", 100.0 - i, ["", "same", words()][min(i % 7, 2)]) for i in range(60)]
    table = [("q", *r) for r in hot + rest] + [("few", *r) for r in rest[:4]]
    items = spark.createDataFrame(table, "q string, candidate_id long, article_id string, source string, card string, score double, text string")
    picked = {}
    for r in sorted(pool.diverse(items, "q", 10).collect(), key=lambda r: r.place):
        picked.setdefault(r.q, []).append(r.candidate_id)
    assert picked == {"q": select_by_force(hot + rest, 10), "few": select_by_force(rest[:4], 10)}
    assert sum(i < 1000 for i in picked["q"]) < 4


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "span_id long, lang string, text string")
    assert profile.routes(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "xx", ""), (3, "en", "x" * 100_000)], "span_id long, lang string, text string")
    assert profile.routes(odd).count() == 3 and profile.integrity(odd).where("status = 'reject'").count() == 3


def test_consensus_and_upsert(spark):
    votes = spark.createDataFrame([(1, "ok", "x"), (1, "ok", "x"), (2, "ok", "x"), (2, "ok", "y"), (3, "ok", "x"), (4, "ok", "x"), (4, "bad", None), (5, "bad", None)], "item long, status string, decision string")
    got = {r["item"]: r["consensus"] for r in feedback.judge_consensus(votes).collect()}
    assert got == {1: "unanimous", 2: "split", 3: "single", 4: "insufficient", 5: "error"}
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, created_at long")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "id long, v string, created_at long")
    assert sorted(tuple(r) for r in pool.upsert(old, new, "id").collect()) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def test_policies_on_four_axes(spark):
    random.seed(8)
    rows = [("x", *(round(random.random(), 3) for _ in range(3)), random.choice(["promoted", "gray", "deprecated"]), random.random() < 0.5) for _ in range(60)]
    now = {"recommended": 0.5, "review_readiness": 0.6, "review_penalty": 0.28, "fallback_review_score": 0.4}
    got = review.search_policies(spark.createDataFrame(rows, "family string, final double, readiness double, penalty double, status string, stable boolean"), now).collect()

    def at(values, q):
        k = (len(values) - 1) * q
        low = int(k)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (k - low)

    def axis(column, anchors, floor, ceil):
        clip = lambda v: max(floor, min(ceil, v))
        values = sorted(clip(r[column]) for r in rows)
        return {round(v, 4) for v in [*map(clip, anchors), *(at(values, q) for q in (0.2, 0.35, 0.5, 0.65, 0.75, 0.85, 0.92))]}

    finals, ready = axis(1, (0.42, 0.46, 0.5, 0.54, 0.58), 0.15, 0.9), axis(2, (0.5, 0.55, 0.6, 0.65), 0.15, 0.95)
    penalties, fallbacks = axis(3, (0.2, 0.24, 0.28, 0.36, 0.44), 0.0, 1.5), axis(1, (0.3, 0.35, 0.4, 0.45), 0.05, 0.85)
    assert len(got) == sum(b <= f for f in finals for b in fallbacks) * len(ready) * len(penalties)
    share = lambda part, whole: sum(part) / len(whole) if whole else 0.0
    for p in random.sample(got, 300):
        chosen = [r for r in rows if r[1] >= p.final_min and r[2] >= p.readiness_min and r[3] <= p.penalty_max]
        queue = [r for r in rows if r not in chosen and r[1] >= p.fallback_min and r[2] >= max(0.15, p.readiness_min - 0.08)]
        assert (p.selected_n, p.review_n) == (len(chosen), len(queue))
        assert p.selected_stable == sum(r[4] == "promoted" or (r[4] != "deprecated" and r[5]) for r in chosen)
        objective = (
            share([r[4] == "promoted" or (r[4] != "deprecated" and r[5]) for r in chosen], chosen) - 1.75 * share([r[4] == "deprecated" for r in chosen], chosen)
            - 0.3 * share([r[4] == "gray" for r in chosen], chosen) + min(0.12, len(chosen) / 60 * 0.24) + min(0.06, share([r[4] == "gray" for r in queue], queue) * 0.06)
            - 0.16 * share([r[4] == "deprecated" for r in queue], queue) + min(0.03, len(queue) / 60 * 0.03)
        )
        assert abs(p.objective - objective) < 1e-4

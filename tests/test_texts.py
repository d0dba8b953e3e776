"""Promotion against a plain walk, refinement against plain Python on texts, common substrings."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellumine.functions import lexicon as L
from vellumine.functions import questions
from vellumine.functions import text as T
from vellumine.operators import dedupe, pool, promotion, refine

TYPES = ("main_idea", "sentence_order", "sentence_fill", "continuation", "rare")


def walk(gray, stable, target, per_type, cap, least):
    """One candidate after another, with counters that change."""
    kinds, articles, sources = Counter(t for r in stable for t in r[3]), Counter(r[1] for r in stable), Counter(r[2] for r in stable)
    ranked = []
    for i, article, source, types, quality, flags in gray:
        if not types or ((quality or 0) < least and all(kinds[t] >= per_type for t in types)):
            continue
        score = 2 * (quality or 0) + sum(max(0, per_type - kinds[t]) for t in types) / max(per_type, 1) + sum(promotion.BONUS.get(t, 0) for t in types)
        ranked.append((-round(score - 0.05 * flags - 0.1 * articles[article] - 0.01 * sources[source], 6), i, article, types))
    out, total = [], len(stable)
    for _, i, article, types in sorted(ranked, key=lambda r: r[:2]):
        if total >= target and all(kinds[t] >= per_type for t in TYPES):
            break
        if articles[article] >= cap:
            continue
        out.append(i)
        total += 1
        articles[article] += 1
        kinds.update(types)
    return sorted(out)


@pytest.mark.parametrize(("target", "per_type", "cap", "least", "rare"), [(30, 8, 2, 0.4, True), (5, 12, 3, 0.0, True), (200, 3, 2, 0.9, True), (10, 4, 1, 0.2, False), (1, 0, 5, 0.5, False), (0, 1, 2, 0.5, True)])
def test_promotion_is_the_walk(spark, target, per_type, cap, least, rare):
    rng = random.Random(target)
    kinds = TYPES if rare else TYPES[:-1]
    make = lambda i: (i, i % 23 if i % 3 else 1, f"s{i % 5 if i % 2 else 0}", [t for t in kinds if rng.random() < (0.03 if t == "rare" else 0.3)], rng.choice([None, 0.2, 0.5, 0.5, 0.9, rng.random()]), rng.randrange(3))
    gray, stable = [make(i) for i in range(120)], [make(1000 + i) for i in range(9)]
    schema = "id long, article_id long, source string, types array<string>, quality double, n_flags int"
    got = promotion.promoted(spark.createDataFrame(gray, schema).repartition(4), spark.createDataFrame(stable, schema), TYPES, target, per_type, cap, least)
    assert sorted(r.id for r in got.collect()) == walk(gray, stable, target, per_type, cap, least)
    none = spark.createDataFrame([], schema)
    assert promotion.promoted(none, none, TYPES, target, per_type, cap, least).count() == 0


def refined_by_force(spans, lang):
    """Spans (kind, paragraph, first, last, text) merged one after another, on their texts."""
    ends = "。！？!?" if lang == "zh" else "。！？!?."
    starts = refine.LEANING if lang == "zh" else L.PACKS[lang]["soft_start"]

    def leans(text):
        if lang == "zh":
            return text.startswith(starts)
        have = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        return any(have[: len(m.split())] == m.split() for m in starts)

    def ask(kind, text):
        if text[-1] not in ends:
            return "next"
        if leans(text) and len(text) < refine.SHORT:
            return "prev"
        if kind == "sentence_group" and len(text) < refine.FINE:
            return "both"
        return "next" if kind == "single_paragraph" and len(text) < refine.SHORT else "keep"

    join = lambda a, b: {**a, "kind": "paragraph_window", "texts": a["texts"] + b["texts"], "last_paragraph": max(a["last_paragraph"], b["last_paragraph"]), "ends": a["ends"] + b["ends"]}
    size = lambda a: len("\n\n".join(a["texts"]))
    every = [{"kind": k, "first_paragraph": p, "last_paragraph": p, "texts": [t], "ends": [x for x in (f, g) if x is not None]} for k, p, f, g, t in spans]
    out, taken = [], set()
    for i, s in enumerate(every):
        if i in taken:
            continue
        want = ask(s["kind"], s["texts"][0])
        follow = every[i + 1] if i + 1 < len(every) else None
        if want in ("prev", "both") and out:
            out[-1] = join(out[-1], s)
            if want == "both" and follow and size(out[-1]) + size(follow) <= refine.MOST:
                out[-1] = join(out[-1], follow)
                taken.add(i + 1)
        elif want == "next" and follow and size(s) + size(follow) <= refine.MOST:
            out.append(join(s, follow))
            taken.add(i + 1)
        else:
            out.append({**s, "kind": s["kind"] if want == "keep" else "paragraph_window"})
    return [(s["kind"], len(s["texts"]), s["first_paragraph"], s["last_paragraph"], min(s["ends"], default=None), max(s["ends"], default=None), "\n\n".join(s["texts"])) for s in out]


def test_refinement(spark):
    rng = random.Random(6)
    sentence = lambda: rng.choice(["But it is so", "So be it", "The long way home is a road that many people take when they are tired of it all", "Yes"]) + rng.choice([".", "!", ".", ",", ""])
    texts = ["\n".join(" ".join(sentence() for _ in range(rng.choice([1, 2, 4, 9, 14]))) for _ in range(rng.choice([1, 2, 6, 15]))) for _ in range(60)]
    texts += ["\n\n".join("".join(rng.choice(["因此如此。", "城市需要更多的公共空间与绿地。", "没有结尾", "对此，人们看法不一！"]) for _ in range(rng.choice([1, 3, 12]))) for _ in range(8)) for _ in range(20)]
    langs = ["en"] * 60 + ["zh"] * 20
    rows = [(i, lang, t) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(900, "en", None), (901, "en", " "), (902, "en", "x" * 5000), (902, "en", "x" * 5000)]
    cut = refine.segments(spark.createDataFrame(rows, "article_id long, lang string, text string").repartition(3))
    own = {r.article_id: (r.lang, [tuple(s) for s in r.segments]) for r in cut.collect()}
    got = {}
    for r in refine.refined(cut).collect():
        got.setdefault(r.article_id, []).append((r.place, *(r[c] for c in ("kind", "n_segments", "first_paragraph", "last_paragraph", "first", "last", "text"))))
    for i, (lang, spans) in own.items():
        want = refined_by_force(spans, lang)
        found = [x[1:] for x in sorted(got.get(i, []), key=lambda x: x[0])]
        assert found == (want if i != 902 else want * 2), i
    assert {n for x in got.values() for _, _, n, *_ in x} > {1, 2, 3} and 900 not in got


def test_longest_common_substring():
    rng = random.Random(3)

    def table(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            above = 0
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], above + 1 if x == y else 0
                best = max(best, row[j])
        return best

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(2))
        assert dedupe.longest_common(a, b) == table(a, b)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    assert dedupe.longest_common(long, "x" + long[500:40_500] + "y" + long[:700]) == 40_000
    assert dedupe.longest_common("", long) == dedupe.longest_common("q", long) == 0


def test_parsed_questions(spark):
    raw = [
        "一、城市发展需要绿地。\n它带来活力。\n填入横线最恰当的一项是（ ）。\nA. 甲\nB、乙\n乙二\nC：丙\nD 丁\n正确答案为 C\n解析：因为丙。\nA项错误",
        "passage\nA one\r\nB two\r\n答案：B",
        "A only\nA again\n解析 x",
        None,
        "  \n ",
        "no parts here",
        "(stem)\nA\nB\nC\nD",
        "x\n这（道）题\nD four\nC three\nB two\nA one\nmore of one",
    ]
    got = [r for r in questions.parsed(spark.createDataFrame(list(enumerate(raw)), "id int, text string").repartition(2)).orderBy("id").collect()]
    part = lambda r: (r.passage, r.stem, [r[f"option_{x}"] for x in "abcd"], r.answer, r.analysis, r.complete)
    assert part(got[0]) == ("城市发展需要绿地。\n它带来活力。", "填入横线最恰当的一项是（ ）。", ["项错误", "乙\n乙二", "丙", "丁"], "C", "正确答案为 C\n解析：因为丙。\nA项错误", True)  # the last A counts
    assert part(got[1]) == ("passage", None, ["one", "two", "", ""], "B", "答案：B", False)
    assert part(got[2]) == (None, None, ["again", "", "", ""], None, "解析 x", False)
    for r in got[3:6]:
        assert part(r) == (None, None, [""] * 4, None, None, False)
    assert part(got[6]) == (None, "(stem)", [""] * 4, None, None, False)
    assert part(got[7]) == ("x", "这（道）题", ["one\nmore of one", "two", "three", "four"], None, "more of one", True)


def test_reselection(spark):
    from test_operators import select_by_force

    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(40))
    item = lambda q, i: (q, i, f"a{i % 7}", f"s{i % 4}", float(rng.randrange(1000)), text())
    base = [item("few", i) for i in range(2)] + [item("many", i) for i in range(30)]
    more = [item("few", 100 + i) for i in range(20)] + [item("many", 200 + i) for i in range(20)] + [item("new", i) for i in range(9)] + [base[0]]
    schema = "q string, candidate_id long, article_id string, source string, score double, text string"
    got = {}
    for r in sorted(pool.reselected(spark.createDataFrame(base, schema), spark.createDataFrame(more, schema), "q", 6, 4).collect(), key=lambda r: r.place):
        got.setdefault(r.q, []).append(r.candidate_id)
    plain = lambda rows, q: select_by_force([(i, a, s, None, x, t) for k, i, a, s, x, t in rows if k == q], 6)
    assert got == {"few": plain(base + more[:-1], "few"), "many": plain(base, "many"), "new": plain(more, "new")}


def test_sequence_similarity(spark):
    """Pairs around the threshold, in both orders, against difflib without bounds."""
    rng = random.Random(3)
    letters = "abcdefghij城市发展"
    rows = [("", ""), ("", "x"), ("x", ""), (None, "x"), ("x", None), ("short", "short"), ("short", "shorx"), ("y" * 79, "y" * 80), ("ab" * 60, "ba" * 60)]
    for _ in range(150):
        a = "".join(rng.choices(letters, k=rng.randint(70, 400)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 12)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2))
        rows += [(a, "".join(b)), ("".join(b), a), (a, "".join(sorted(a)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")
    got = {r.id: r.alike for r in dedupe.sequence_similarity(df).collect()}
    want = {}
    for i, (a, b) in enumerate(rows):
        a, b = a or "", b or ""
        want[i] = not a or a == b or (min(len(a), len(b)) >= 80 and SequenceMatcher(None, a, b).ratio() >= 0.92)
    assert got == want and 50 < sum(want.values()) < len(rows) - 150


def test_tokens_and_support(spark):
    cases = [("城市A1发展，x的 答案 Mix-ed 2024", "发展的mix"), ("", "ab"), ("ab", ""), ("一", "一"), ("根据材料", "据材料"), ("a b cc CC cc", "CC dd")]

    def tokens(x):
        x, own = x.lower(), [c for c in x if "一" <= c <= "鿿"]
        return ({w for w in re.findall("[a-z0-9]{2,}", x)} | {a + b for a, b in zip(own, own[1:])}) - set(T.STOP_PAIRS)

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id int, a string, b string")
    out = df.select("id", T.tokens(F.col("a")).alias("e"), T.tokens(F.col("b")).alias("c")).withColumn("s", T.support(F.col("e"), F.col("c")))
    for r in out.collect():
        e, c = map(tokens, cases[r.id])
        assert set(r.e) == e and len(r.e) == len(e) and set(r.c) == c
        assert tuple(r.s) == (len(e & c), len(c), round(len(e & c) / len(c), 4) if e and c else 0.0)

"""Neutral and order signals against plain Python, on Chinese and other texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumine.functions import lexicon as L
from vellumine.functions import markers as M
from vellumine.functions import text as T
from vellumine.operators import neutral, order_signals

CHINESE = [
    "问题在于，基础薄弱。因此，应当采取措施。此外，也要推动发展！这说明机制在于驱动。总之，关键在于落实。",
    "为什么要改革？因为质量不高。首先，完善制度；其次，提升效率。最后，改善服务，惠及群众。",
    "一方面，城市需要活力。另一方面，乡村也需要活力。但是，矛盾仍在。看似简单，却并非如此。未来还需要进一步探索。",
    "共享单车就是公共服务。共享单车，共享单车。例如，一位市民说。他们认为，这一案例值得重视。要尽量避免浪费。",
    "如果先行动，后反思，那么就能进步。只有坚持，才能成功。随后，人们发现问题。其一是成本。其二是安全。更重要的是，信心增强。",
    "",
    "短句",
    "①首先建立机制。②其次优化流程。③再次强化监督。④然后推广经验。⑤最后总结成效。⑥因此实现共赢。",
    "第一行：问题是什么\n第二行：因此需要办法\n第三行：这也带来活力\n",
]
ENGLISH = [
    "For example, this is how it was. However, they must go on for all of us. Therefore the measures, then, are many. It is important.",
    "But why? Because of the problem. After that, only the method helps. These are, in short, the issue, for example, and so on. A of of of the.",
    "Word " * 40,
]


def spans(spark):
    rng = random.Random(5)
    texts = [(t, "zh") for t in CHINESE] + [(t, "en") for t in ENGLISH] + [(None, "en"), ("no pack here. none!", "it"), ("x", None)]
    texts += [("".join(rng.sample([s + "。" for t in CHINESE[:5] for s in t.split("。") if s], rng.randint(1, 14))), "zh") for _ in range(30)]
    kinds = ("whole_passage", "functional_slot_unit", "insertion_context_unit", "sentence_block_group", "ordered_unit_group")
    rows = [(i, lang, t, kinds[i % 5], "g", i % 4, i % 4 + 1, ("middle", "ending", None)[i % 3], ("bridge", "countermeasure", "x")[i % 3]) for i, (t, lang) in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "span_id long, lang string, text string, candidate_type string, document_genre string, first_paragraph int, last_paragraph int, slot_position string, slot_function string").repartition(3)


def words(text):
    return "".join(c.lower() if c.isalpha() or c in "0123456789" else " " for c in text).split()


def occurrences(text, lang, group):
    """Every marker of the group counted by itself."""
    if lang not in L.PACKS:
        return 0
    if lang == "zh":
        return sum(text.count(m) for m in M.markers("zh", group))
    have = words(text)
    return sum(have[i : i + len(m.split())] == m.split() for m in M.markers(lang, group) for i in range(len(have)))


def begins(text, lang, group):
    if lang not in L.PACKS:
        return False
    have = words(text)
    return any(text.startswith(m) if lang == "zh" else have[: len(m.split())] == m.split() for m in M.markers(lang, group))


def strength(n):
    return round(min(1.0, 0.18 * n + (0.30 if n else 0.0)), 4)


def sentences_of(df):
    return {r.span_id: r.s or [] for r in df.select("span_id", T.sentences(T.strip(F.coalesce("text", F.lit(""))), F.col("lang")).alias("s")).collect()}


def test_scan_counts_every_marker(spark):
    rows, df = spans(spark)
    sents = sentences_of(df)
    groups = list(M.GROUPS)
    scanned = df.select("span_id", M.scan(T.sentences(T.strip(F.coalesce("text", F.lit(""))), F.col("lang")), F.col("lang")).alias("x"))
    for part in range(0, len(groups), 12):
        some = groups[part : part + 12]
        each = F.transform("x", lambda u: F.struct(*(M.count(u["hits"], g).alias(f"n_{g}") for g in some), *(M.starts(u["start"], g).alias(f"s_{g}") for g in some)))  # noqa: B023
        for r in scanned.select("span_id", each.alias("each")).collect():
            lang = rows[r.span_id][1]
            for text, got in zip(sents[r.span_id], r.each, strict=True):
                assert [got[f"n_{g}"] for g in some] == [occurrences(text, lang, g) for g in some], text
                assert [got[f"s_{g}"] for g in some] == [begins(text, lang, g) for g in some], text


def test_strengths_and_objects(spark):
    rows, df = spans(spark)
    sents = sentences_of(df)
    for r in neutral.observed(df).collect():
        text, lang, own = rows[r.span_id][2] or "", rows[r.span_id][1], sents[r.span_id]
        windows = {"t": own, "h": own[:1], "z": own[-1:], "a": own[:2], "e": own[-2:]}
        for w, groups in neutral.STRENGTHS.items():
            for g in groups:
                assert r[f"m_{w}_{g}"] == strength(sum(occurrences(s, lang, g) for s in windows[w])), (text, w, g)
        if lang == "en":
            objects = Counter(w for w in words(text) if len(w) >= neutral.OBJECT_LETTERS)
            top = objects.most_common(1)
            assert r.core_object == (top[0][0] if top else neutral.NO_OBJECT) and r.theme_words == [w for w, _ in objects.most_common(5)]
            assert r.core_object_anchor_strength == pytest.approx(min(1, 0.35 + top[0][1] / max(4, sum(objects.values()))) if top else 0, abs=1e-4)


def test_signals_of_a_known_text(spark):
    rows, df = spans(spark)
    got = {r.span_id: r for r in neutral.neutral_signals(df).collect()}
    assert len(got) == len(rows) and len(got[0]) == 2 + 80
    first, question, last = got[0], got[1], got[4]
    assert first.closing_anchor_type == "summary" and first.opening_anchor_type == "problem_opening" and first.candidate_type == "whole_passage"
    assert question.title_rhetoric_form == "question" and question.benefit_result_count > 0.5 and question.logic_relation == "action" and question.function_type == "countermeasure"
    assert got[3].closing_anchor_type == "call_to_action" and got[3].core_object == "共享单车"
    assert last.necessary_condition_strength == strength(2) and "condition" not in got[6].logic_relations
    empty = got[5]
    assert empty.core_object == neutral.NO_OBJECT and empty.tail_anchor == "" and empty.theme_words == [] and empty.benefit_result_strength == 0.0


def brute_order(own, lang):
    has = lambda u, g: occurrences(u, lang, g) > 0
    leans = lambda u: begins(u, lang, "pronoun") or begins(u, lang, "context")
    n = len(own)
    roles = []
    for i, u in enumerate(own):
        for name, group in (("summary", "closing"), ("action", "countermeasure"), ("problem", "order_problem"), ("question", "order_question"), ("definition", "definition"), ("example", "order_example")):
            if has(u, group):
                roles.append(name)
                break
        else:
            roles.append(
                "dependent" if leans(u) else "turning" if has(u, "order_turning") else "parallel" if has(u, "order_parallel") else "timeline" if has(u, "order_action")
                else "viewpoint" if has(u, "viewpoint") else "tail_statement" if i == n - 1 else "statement"
            )
    scores = []
    for i, u in enumerate(own):
        x = 0.28 + 0.32 * has(u, "definition") + 0.22 * has(u, "order_problem") + 0.18 * has(u, "claim") - 0.18 * has(u, "order_closing")
        x -= 0.28 * (begins(u, lang, "pronoun") or has(u, "plain_example")) + 0.22 * begins(u, lang, "context") + 0.10 * has(u, "order_turning")
        x += 0.06 * (i == 0) + 0.16 * (i == 0 and has(u, "beginning"))
        scores.append(round(max(0.0, min(1.0, x)), 4))
    best = sorted(scores, reverse=True) + [0.0, 0.0]
    bonds = 0
    for a, b in zip(own, own[1:]):
        bonds += bool(
            leans(b) or has(b, "order_turning") or has(b, "order_parallel") or has(b, "follow") or (has(a, "order_question") and has(b, "answer")) or (has(a, "order_problem") and has(b, "order_solution"))
            or (has(a, "only") and has(b, "then_only")) or (has(a, "if") and has(b, "then"))
        )
    overlap = 1.0 if n <= 1 else 0.72 * sum(k - 1 for k in Counter(roles).values()) / (n - 1) + 0.28 * sum(has(u, "countermeasure") for u in own) / n
    timed = min(4, sum(occurrences(u, lang, "timed") for u in own)) * 0.18 + 0.18 * any(has(u, "before") and has(u, "after") for u in own)
    steps = 0.14 * min(4, sum(has(u, "order_action") for u in own)) + 0.18 * min(3, sum(has(u, "steps") for u in own))
    return roles, min(4, bonds), 0.68 * best[0] + 0.32 * max(0, best[0] - best[1]) if n else 0.0, overlap, min(1, timed), min(1, steps)


def test_order_signals(spark):
    rows, df = spans(spark)
    found = order_signals.with_units(df.withColumn("body", T.strip(F.coalesce("text", F.lit("")))))
    parts = {r.span_id: r.units or [] for r in found.select("span_id", "units").collect()}
    # units: lines, parts between circled numbers, six of seven to twelve
    assert parts[8] == [x for x in CHINESE[8].split("\n") if x]
    rest = {r.span_id: r for r in neutral.neutral_signals(df).collect()}
    shares = {r.span_id: r.directive_share for r in order_signals.unit_signals(found).select("span_id", "directive_share").collect()}
    parallels = {r.span_id: r.m_t_order_parallel for r in neutral.observed(df).select("span_id", "m_t_order_parallel").collect()}
    got = {r.span_id: r for r in order_signals.order_signals(df).collect()}
    sents = sentences_of(df)
    for i, r in got.items():
        if rows[i][3] not in order_signals.GROUPED:
            assert parts[i] == sents[i] if not 6 < len(sents[i]) <= 12 else len(parts[i]) in (6, len(sents[i]))
        roles, bonds, opener, overlap, timed, steps = brute_order(parts[i], rows[i][1])
        assert r.roles == roles and r.binding_pair_count == bonds and r.n_units == len(roles), rows[i]
        same = lambda a, b: a == pytest.approx(b, abs=1e-4)
        assert same(r.unique_opener_score, opener) and same(r.function_overlap_score, overlap) and same(r.temporal_order_strength, timed) and same(r.action_sequence_irreversibility, steps)
        s = rest[i]
        progression = 0.22 * s.opening_signal_strength + 0.18 * s.local_binding_strength + 0.22 * s.closing_signal_strength + 0.20 * s.sequence_integrity + 0.08 * timed + 0.10 * (1 - overlap)
        closure = 0.34 * progression + 0.26 * s.closing_signal_strength + 0.22 * s.sequence_integrity + 0.18 * (1 - s.context_dependency)
        free = 1 - min(1, bonds / 3)
        risk = 0.30 * overlap + 0.20 * free + 0.18 * (1 - opener) + 0.12 * (1 - closure) + 0.10 * parallels[i] + 0.06 * shares[i] + 0.02 * (1 - timed) + 0.02 * (1 - steps)
        paths = 0.34 * risk + 0.22 * overlap + 0.18 * (1 - opener) + 0.14 * free + 0.06 * (1 - progression) + 0.06 * (1 - closure)
        assert r.discourse_progression_strength == pytest.approx(progression, abs=3e-4) and r.context_closure_score == pytest.approx(closure, abs=3e-4)
        assert r.exchange_risk == pytest.approx(min(1, risk), abs=3e-4) and r.multi_path_risk == pytest.approx(min(1, paths), abs=3e-4)

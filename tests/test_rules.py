"""Rule sets and search operators against plain Python on small inputs."""

import hashlib
import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.operators import dedupe, evaluate, pool, rules, scoring, search
from vellumine.plans import catalogue, rule_queries, search_queries

DATA = "/root/testdata/sf0.001"


def cut(x):
    return max(0.0, min(1.0, x))


def near(a, b):
    return abs(a - b) < 2e-4


def drawn(spark, signals, n=300, **inputs):
    """Random rows of signals and inputs, as dicts and as a table."""
    random.seed(7)
    rows = [{"id": i, **{s: random.random() for s in signals}, **{k: random.choice(v) for k, v in inputs.items()}} for i in range(n)]
    return rows, spark.createDataFrame(rows)


def test_main_idea(spark):
    rows, table = drawn(spark, scoring.MAIN_SIGNALS, candidate_type=["whole_passage", "closed_span", "functional_slot_unit"], n_paragraphs=[1, 5], n_sentences=[3, 9])
    lifted = [r for r in rows[:150]]
    for r in lifted:  # rows that can pass
        r.update({k: 0.8 + r[k] / 5 for k in ("single_center_strength", "object_scope_stability", "closure_score", "titleability", "analysis_to_conclusion_strength", "summary_strength")})
        r.update({"branch_focus_strength": 0.1, "non_key_detail_density": 0.1})
    table = spark.createDataFrame(rows)
    got = {r.id: r for r in rules.apply(table, [*scoring.ELIGIBILITY, *scoring.MAIN_TASK]).collect()}
    seen = set()
    for r in rows:
        g = got[r["id"]]
        seen.add(g.eligibility)
        if r["candidate_type"] == "functional_slot_unit":
            assert (g.eligibility, g.mi_center, g.mi_example, g.main_idea_recommended) == ("unsupported_unit_type", 0, 1, False)
            continue
        center = cut(0.38 * r["single_center_strength"] + 0.24 * r["object_scope_stability"] + 0.18 * r["core_object_anchor_strength"] + 0.1 * (r["titleability"] + r["multi_dimension_cohesion"]) - 0.18 * r["branch_focus_strength"])
        example = cut(0.42 * r["non_key_detail_density"] + 0.18 * max(0, 0.58 - r["example_to_theme_strength"]) + 0.16 * r["case_macro_shift_strength"] + 0.14 * r["branch_focus_strength"] + 0.1 * max(0, 0.56 - r["titleability"]))
        assert near(g.mi_center, center) and near(g.mi_example, example)
        ready = 0.4 * g.mi_center + 0.3 * g.mi_closure + 0.3 * g.mi_lift
        assert near(g.main_idea_readiness, ready) and near(g.main_idea_final, cut(ready - 0.35 * g.mi_example))
        assert g.main_idea_recommended == (g.eligibility == "main_idea_eligible" and g.main_idea_final >= 0.5)
    assert {"main_idea_eligible", "single_center_weak", "unsupported_unit_type"} <= seen


def test_fill_and_order(spark):
    rows, table = drawn(
        spark, scoring.FILL_SIGNALS, candidate_type=["functional_slot_unit"], function_type=[*scoring.FUNCTIONS, "other"], blank_value_ready=[True, True, False], slot_explicit_ready=[True, False], n_sentences=[1, 2],
        n_chars=[20, 90], context_sentences=[0, 3, 9],
    )
    for r, g in zip(rows, sorted(rules.apply(table, scoring.FILL_TASK).collect(), key=lambda g: g.id), strict=True):
        parts = sorted((r["carry_dependency"], r["bridge_dependency"], r["forward_dependency"]), reverse=True)
        doubt = cut(max(0, 0.28 - (parts[0] - parts[1])) / 0.28)
        assert near(g.role_ambiguity, doubt) and near(g.role_confidence, cut(parts[0] + 0.12 * r["slot_explicit_ready"] - 0.4 * doubt))
        own = {"carry_previous": r["carry_dependency"], "bridge": r["bridge_dependency"], "lead_next": r["forward_dependency"], "summary": r["summary_strength"], "conclusion": r["summary_strength"]}.get(r["function_type"])
        if own is not None:
            assert near(g.blank_value, max(0.58, own) if r["blank_value_ready"] else 0)
        final = g.fill_readiness - 0.25 * g.standalone - 0.15 * g.role_ambiguity - 0.1 * g.overlong
        assert near(g.fill_final, cut(final)) and near(g.overlong, cut(0.55 * (r["n_sentences"] - 1) + 0.45 * max(0, r["n_chars"] - 48) / 52))
    rows, table = drawn(
        spark, scoring.ORDER_SIGNALS, candidate_type=scoring.ORDER_TYPES, first_held=[True, False], n_first=[1, 2, 3], last_held=[True, True, False], n_last=[1, 2, 3], n_precedence=[0, 2, 4], n_bindings=[0, 1, 3],
        n_grouped=[0, 1, 4], n_units=[5, 6],
    )
    for r, g in zip(rows, sorted(rules.apply(table, scoring.ORDER_TASK).collect(), key=lambda g: g.id), strict=True):
        stable = lambda held, n: 0 if not held else {1: 1, 2: 0.78}.get(n, 0.56)
        assert near(g.first_fit, 0.55 * stable(r["first_held"], r["n_first"]) + 0.45 * r["unique_opener_score"]) and near(g.last_instability, 1 - stable(r["last_held"], r["n_last"]))
        pairs = cut(0.22 * r["n_precedence"] + 0.12 * r["n_bindings"] + 0.32 * r["sequence_integrity"])
        assert near(g.pairwise, pairs) and near(g.weak_constraint, max(0, 0.55 - pairs) / 0.55)
        assert g.order_recommended == (r["candidate_type"] == "ordered_unit_group" and r["n_units"] == 6 and g.order_final >= 0.56)
        vector = [g.order_complexity, g.order_ambiguity, g.order_depth, g.order_constraint]
        hard = sum(x >= 0.67 for x in vector) >= 2 and sum(x >= 0.62 for x in vector[1:]) >= 2 or g.order_difficulty >= 0.68
        assert (g.order_band == "hard") == hard


def test_plan_scope(spark):
    rows = [("whole_passage", 6, 3), ("whole_passage", 7, 3), ("multi_paragraph_unit", 9, 2), ("closed_span", 9, 3), ("functional_slot_unit", 9, 2), ("ordered_unit_group", 9, 4), ("insertion_context_unit", 9, 1), ("closed_span", 0, 1), ("closed_span", 4, None)]
    inputs = {s: "0.5e0" for s in scoring.PLAN_SIGNALS} | {f: "false" for f in ("slot_explicit_ready", "repeated_openings", "heading_like", "directive_like", "dependent_opening", "planned_by_model")}
    inputs |= {"composition": "'x'", "blank_position": "'middle'", "function_type": "'bridge'", "n_units": "6", "n_bindings": "1"}
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, candidate_type string, n_paragraphs int, covered int")
    got = {r.id: r for r in rules.apply(table, [inputs, *scoring.PLAN]).collect()}
    assert [round(got[i].scope_bonus, 2) for i in range(len(rows))] == [0.04, -0.08, 0.06, -0.04, 0.08, -0.06, 0, 0, 0]
    assert near(got[0].plan_score, 0.5 * (0.34 + 0.24 + 0.22 + 0.10 + 0.08) + 0.04) and got[0].planned and not got[1].planned
    # nulls of signals count as nothing once filled
    assert rules.filled(table.withColumn("x", F.lit(None)), ["x"]).where("x <> 0").count() == 0


def test_search_path(spark):
    rows = [(1, "promoted", "stable", True, 0.9, "title", ["title", "fill"]), (2, "promoted", "stable", True, 0.8, "fill", ["fill"]), (3, "gray", "gray", True, 0.7, "fill", None), (4, "promoted", "stable", False, 1.0, "fill", ["fill"])]
    table = spark.createDataFrame(rows, "id int, status string, release_channel string, is_primary boolean, quality_score double, primary_family string, families array<string>").withColumn("updated_at", F.lit(0))
    assert [r.id for r in search.index_scan(table, "fill", 1).collect()] == [1]
    reviews = spark.createDataFrame([(1, "review_rejected"), (4, "auto_tagged")], "id int, review_status string")
    assert [r.id for r in search.fallback_scan(table, reviews, "fill").collect()] == [2]
    assert {r.id: r.allowed for r in search.promotion_verdicts(table.select("id", "status", "release_channel"), reviews).collect()} == {1: False, 2: False, 3: True, 4: True}
    types = spark.createDataFrame([("title", "main"), ("fill", "slot"), ("none", "unseen")], "family string, question_type string")
    assert {tuple(r) for r in search.type_coverage(table, types).collect()} == {("main", 1, 1), ("slot", 4, 3), ("unseen", 0, 0)}
    empty = table.where("false")
    assert search.pool_search(empty, 0.5, None).count() if "fit_scores" in empty.columns else search.counters(empty, ["status"]).count() == 0


def test_payloads_and_slots(spark):
    rows = [(1, '{"t":{"final":0.5,"penalties":{"a":0.25,"b":null}},"n":null}'), (2, "{broken"), (3, None), (4, "{}"), (5, '{"t":{"final":"NaN","task_family":" "}}')]
    table = spark.createDataFrame([(i, i, p) for i, p in rows], "id int, article_id int, payload string")
    none = spark.createDataFrame([], "id int, review_status string")
    got = sorted((r.id, r.family, r.task_family, r.final, r.total_penalty) for r in search.flatten_payload(table, none).collect())
    assert got == [(1, "t", "t", 0.5, 0.25), (5, "t", "t", 0.0, 0.0)]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "y"}), (None, None)], "p map<string, string>, q map<string, string>")
    assert [dict(r[0]) for r in maps.select(search.merged_slots(F.col("p"), F.col("q"))).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}, {}]


def test_blank_positions(spark):
    rows = ["____ rest of it all", "start of it ____ and then some more text", "a long start of the text ____", "none", None, " ( ) x"]
    table = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r[0] for r in table.select(search.blank_position(F.col("t"))).collect()] == ["opening", "middle", "ending", "", "", "opening"]


def test_repeated_units_query(spark):
    """The registered query against plain Python, over its whole table."""
    units = {r.article_id: list(r.sents) for r in catalogue.segment.units(catalogue.articles(spark, DATA)).collect()}
    for r in search_queries.repeated_units(spark, DATA).collect():
        seen, n = [], 0
        for u in units[r.article_id]:
            s = re.sub(r"[^\w]|_", "", u.lower())
            if len(s) >= 10:
                if any(s in x or x in s for x in seen):
                    n += 1
                else:
                    seen.append(s)
        assert (r.n_units, r.n_repeated) == (len(units[r.article_id]), n)


def test_near_duplicate_spans_query(spark):
    """The registered query against plain Python, over its whole table."""
    units = {r.article_id: list(r.paras) for r in catalogue.segment.units(catalogue.articles(spark, DATA)).collect()}
    got = {(r.article_id, r.span): (r.cluster, r.survivor) for r in catalogue.near_duplicate_spans(spark, DATA).collect()}
    assert len(got) == sum(map(len, units.values()))
    for key, items in units.items():
        for i, x in enumerate(items):
            for j in range(i):
                if dedupe.normal(x) == dedupe.normal(items[j]) != "":
                    assert got[key, i][0] == got[key, j][0]
        for c in {got[key, i][0] for i in range(len(items))}:
            members = [i for i in range(len(items)) if got[key, i][0] == c]
            assert [i for i in members if got[key, i][1]] == [min(members, key=lambda i: (abs(len(items[i]) - dedupe.TARGET_LENGTH), i))]


def test_survivors_follow_ranks(spark):
    rank = "struct<n_flags: int, gray: int, no_subtype: int, lost: double>"
    table = spark.createDataFrame([(1, ["a b c d e f g", "a b c d e f g"], [(1, 0, 0, -0.5), (0, 1, 1, -0.1)]), (2, None, None)], f"article_id long, items array<string>, ranks array<{rank}>")
    assert [(r.span, r.survivor) for r in dedupe.merge_spans(table).orderBy("span").collect()] == [(0, False), (1, True)]


def test_normalised_hash(spark):
    table = spark.createDataFrame([("“ａ，b”　（c）、 d",)], "t string")
    assert table.select(T.normalised_hash(F.col("t"))).first()[0] == hashlib.sha1('"ａ,b"（c）、d'.encode()).hexdigest()


def test_links(spark):
    page = """<a href='/a/one.html#x'>A rather long title</a><A HREF=two?from=x&q=1>Two</A> <a href="mailto:x@y">m</a><script>var u = "https://site.org\\/news\\/12.html", v = "/style.css";</script><a href="http://other.org/news/1.html">o</a>"""
    pages = spark.createDataFrame([(1, "https://site.org/dir/page", page), (2, "https://site.org/", None)], "page_id long, url string, html string")
    got = [(r.link, r.place) for r in pool.discovered(pages, patterns=(r"/news/\d+", "/a/", "two")).orderBy("place").collect()]
    assert got == [("https://site.org/news/12.html", 1), ("https://site.org/a/one.html", 2), ("https://site.org/dir/two?q=1", 3)]
    with pytest.raises(ValueError):
        pool.term_search(pages, ["x"] * 13, ("html",))


def test_threshold_grid_against_all_records(spark):
    random.seed(3)
    rows = [(random.choice("ab"), random.choice([None, 0.1, 0.5, 0.6, 0.9]), random.random(), random.choice([0.2, 0.5, 0.7]), random.random() < 0.5) for _ in range(300)]
    table = spark.createDataFrame(rows, "family string, final double, readiness double, penalty double, positive boolean")
    for r in evaluate.threshold_grid(table, [0.6, 0.5], [0.3, 0.7], [0.5, 0.2]).collect():
        own = [x for x in rows if x[0] == r.family]
        kept = [x for x in own if x[1] is not None and x[1] >= r.final_min and x[2] >= r.readiness_min and x[3] <= r.penalty_max]
        assert (r.n, r.positives, r.kept, r.kept_positive) == (len(own), sum(x[4] for x in own), len(kept), sum(x[4] for x in kept))


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """Without the subpackage and the pipeline the entry module imports and has all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/vellumine", f"{tmp_path}/vellumine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, vellumine.plans.catalogue as c; assert set(e.queries()) == set(c.QUERIES) and len(c.QUERIES) > 100 and not set(e.oracle_sql()) - set(c.QUERIES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_adapted_windows_query(spark):
    """The registered query against plain Python, over its whole table."""
    units = {r.article_id: list(r.sents) for r in catalogue.segment.units(catalogue.articles(spark, DATA)).collect()}
    got = {r.article_id: (r.first, r.last) for r in search_queries.adapted_windows(spark, DATA).collect()}
    assert got.keys() == {k for k, v in units.items() if v}
    for key, (first, last) in got.items():
        sents = units[key]
        a = b = len(sents) // 2
        while sum(map(len, sents[a : b + 1])) < 340 and (a > 0 or b < len(sents) - 1):
            left = len(sents[a - 1]) if a > 0 else None
            right = len(sents[b + 1]) if b < len(sents) - 1 else None
            if left is not None and (right is None or left <= right):
                a -= 1
            else:
                b += 1
        assert (first, last) == (a, b)


def test_business_scores(spark):
    signals = {s: "0.5e0" for s in scoring.BUSINESS_SIGNALS} | {f"has_{k}": "false" for k in scoring.RELATION_SIGNALS} | {f"n_{k}": "0" for k in ("turn", "cause", "conclusion", "condition", "counter", "parallel")}
    base = signals | {"conclusion_position": "'none'"}
    cases = [
        ("turn", True, {}, {}, 0.35 * 0.5 + 0.2 * 0.5 + 0.15 * 0.5 + 0.1 * 0.5), ("turn", True, {}, {"n_turn": "2"}, 0.35 * 0.82 + 0.2 + 0.125), ("cause", False, {"true": 0.35}, {"n_cause": "1", "n_conclusion": "1"}, 0.35 * 0.88 + 0.1 + 0.2 * 0.35 + 0.125 + 0.18),
        ("parallel", False, {}, {"has_parallel": "true"}, 0.35 * 0.92 + 0.1 + 0.125), ("theme", False, {}, {"turning_focus_strength": "0.6e0"}, 0.4 - 0.12),
    ]
    for kind, marker, structure, own, expected in cases:
        row = rules.apply(spark.range(1), [base | own, {"x": scoring.business_score(kind, marker, structure)}]).first()
        assert near(row.x, expected), (kind, row.x, expected)
    row = rules.apply(spark.range(1), [base, {"x": scoring.business_score("turn", False, {}, None, True)}]).first()
    assert row.x is None  # the hard filter asks for 0.52


def test_guarded_ranking_query(spark):
    """The registered query against plain Python, over its whole table."""
    rows = rule_queries.ranking.ranked(rule_queries.candidates(spark, DATA, rule_queries._RANK_DRAWN, [rule_queries._RANK_INPUTS]), "query", rule_queries.RANKED).where("family = 'sentence_fill'").collect()
    swaps = 0
    got = {(r.query, r.place): (r.id, r.place_before) for r in rule_queries.guarded_ranking(spark, DATA).collect()}
    for query in {r.query for r in rows}:
        own = sorted((r for r in rows if r.query == query), key=lambda r: r.place)
        for i in range(len(own) - 1):
            h, x = own[i], own[i + 1]
            keys = lambda r, n: tuple(r[f"k{j}"] for j in range(1, n + 1))
            if h.candidate_type not in ("multi_paragraph_unit", "whole_passage") or x.candidate_type not in ("closed_span", "functional_slot_unit"):
                continue
            edge = h.blank_position in ("opening", "inserted") and not h.covered
            if not (keys(h, 7) > keys(x, 7) and h.selection - x.selection <= 0.045 and edge and x.compact_fit >= h.compact_fit + 0.03):
                continue
            better = x.quality < h.quality or x.card_score < h.card_score or x.business_score < h.business_score
            near_first = h.k1 - x.k1 <= 0.03
            tied = keys(x, 4) >= keys(h, 4) or (near_first and h.k2 - x.k2 <= 0.015 and better) or (near_first and x.compact_fit >= h.compact_fit + 0.18 and better)
            tied = tied or (h.k1 - x.k1 <= 0.012 and x.k2 >= h.k2 + 0.03 and x.compact_fit >= h.compact_fit + 0.12 and h.width >= x.width)
            if tied:
                own[i], own[i + 1] = x, h
                swaps += 1
        assert [got[query, i + 1] for i in range(len(own))] == [(r.id, r.place) for r in own]
    assert swaps > 0

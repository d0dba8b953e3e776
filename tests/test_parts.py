"""Plugins, fetching, readability, labels and terms against plain Python on small inputs."""

import collections
import re
from urllib.error import HTTPError, URLError

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumine import plugins
from vellumine.functions import readable
from vellumine.operators import labels, reports
from vellumine.plans import catalogue, label_queries, search_queries, suite
from vellumine.sources import fetch

DATA = "/root/testdata/sf0.001"


def test_registry_and_loader():
    held = plugins.Registry()
    plugins.load([*plugins.BUILT_IN, {"name": "off", "module": "nowhere", "class": "X", "enabled": False}], held)
    plugins.load(plugins.BUILT_IN, held)  # names that are taken are passed over
    assert held.names() == ["keyword_tagger", "feature_tagger"]
    with pytest.raises(ValueError):
        held.register(plugins.KeywordTagger())


def test_built_in_taggers(spark):
    spans = spark.createDataFrame([(1, "然而 alpha beta。"), (2, None), (3, "x" * 200 + "\n\n总之")], "span_id int, text string")
    got = {r.span_id: ([h.evidence for h in r.hits], r.review_status) for r in plugins.KeywordTagger().tag(spans, {"node_id": "n", "aliases": ["alpha", "", "beta", "no"]}).collect()}
    assert got == {1: (["alpha", "beta"], "auto_tagged"), 2: ([], "review_pending"), 3: ([], "review_pending")}
    assert plugins.KeywordTagger().tag(spans, {}).where("size(hits) > 0").count() == 0
    got = {r.span_id: (r.keep, r.features["transition_strength"], r.features["summary_strength"], r.features["independence_score"], r.features["conclusion_sentence_strength"]) for r in plugins.FeatureTagger().tag(spans, {}).collect()}
    assert got == {1: (False, 0.7, 0.3, 0.5, 0.6), 2: (False, 0.2, 0.3, 0.5, 0.2), 3: (True, 0.2, 0.7, 0.8, 0.2)}
    assert not plugins.NoProvider().enabled() and plugins.NoProvider().votes(spans).count() == 0


def test_decoding():
    assert fetch.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert fetch.decode('<meta charset="gbk">中文'.encode("gbk")) == '<meta charset="gbk">中文'
    assert fetch.decode("中文".encode()) == fetch.decode("中文".encode("gb18030")) == "中文"
    assert fetch.decode(b"\xff\xff\xff", "charset=nonsense").count("�") == 3


def test_fetching_tries_again():
    calls = collections.Counter()

    def opener(url, timeout):
        calls[url] += 1
        if url == "late" and calls[url] < 3:
            raise URLError("x")
        if url == "gone":
            raise HTTPError(url, 404, "", {}, None)
        if url == "down":
            raise TimeoutError
        return b"text", ""

    assert [fetch.fetched(u, opener, 3, 0.001) for u in ("late", "gone", "down")] == [("text", None), (None, "status 404"), (None, "TimeoutError")]
    assert calls == {"late": 3, "gone": 1, "down": 4}


def test_fetch_table_schedule_and_sync(spark):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")

    def opener(url, timeout):
        if url == "b":
            raise OSError
        return url.encode(), ""

    assert {tuple(r) for r in fetch.fetch(urls, opener, 0, 0.0).collect()} == {("a", "a", None), ("b", None, "OSError")}
    assert fetch.crawl_schedule([{"id": "x", "schedule": {"cron": "1 2 * * 0"}}, {"id": "y"}, {"id": "z", "enabled": False, "schedule": {"cron": "0 0 * * *"}}]) == {"x": {"minute": "1", "hour": "2", "day": "*", "month": "*", "day_of_week": "0"}}
    fetch.sync()(spark.createDataFrame([(1, "t")], "id int, text string"), 0)


def test_readable(spark):
    wrong = "我们的时代是这样的".encode().decode("gb18030", "ignore")
    assert "时代" in readable.readable_text(wrong) and readable.readable_text("plain é text") == "plain é text"
    assert readable.readable_text("a&amp;b\\u00a0c \n\n\n\n d\x07") == "a&b c\n\nd" and readable.readable_text("<w:p>x</w:p>") == "x" and readable.readable_text(None) == ""
    cases = [('{"b":1,"a":2} rest', '{"a":2,"b":1}'), ('x ```json\n{"a":1}\n```', '{"a":1}'), ('see {"a":{}} end', '{"a":{}}'), ("[1]", None), (None, None), ("{", None)]
    assert [readable.salvaged_object(t) for t, _ in cases] == [x for _, x in cases]
    rows = spark.createDataFrame([("a b<w:p>",), (" ",), (None,), ("鏄锛\x01",), ("fine",)], "t string")
    assert [r[0] for r in rows.select(readable.issues(F.col("t"))).collect()] == [["word_xml_leak", "escaped_nbsp"], [], [], ["control_characters", "mojibake_text"], []]


def test_readability_issues_of_odd_texts(spark, tmp_path):
    """The registered query against its SQL on null and blank texts, and on flags that nobody planted."""
    odd = [None, "", " ", "\xa0", "\u3000 \u2009", "\n", "\t\x0b", "\u200b", "\ufeff", "</w:p>", "<w:", "a\\u00a0b \\xA0", "a\x01b\x7f", "\x07", "鏄鏄", "锛 is 鐨 x", "plain", "x\xa0y"]
    rows = spark.createDataFrame([(i * 5 + kind, x) for i, x in enumerate(odd) for kind in range(5)] + [(None, "x\x07"), (-2, None)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    by = lambda found: sorted(map(tuple, found), key=str)
    assert by(label_queries.readability_issues(spark, str(tmp_path)).collect()) == by(con.sql(catalogue.ORACLES["readability_issues"]).fetchall())


def test_subtypes_keep_three_of_a_family(spark):
    held = {r: "true" for r in ("role_tail_summary", "role_opening", "role_after_turn")}
    signals = {s: "0.9e0" for s in label_queries.SIGNALS}
    rest = {f: "false" for f in label_queries.FLAGS if f not in held and f not in ("sequence_markers",)}
    row = spark.range(1).selectExpr("id", *(f"{v} AS {k}" for k, v in (held | signals | rest | {"sequence_markers": "0"}).items()))
    (r,) = labels.subtypes(row).collect()
    own = [(c.subtype, -c.by) for c in r.candidates if c.family == "summary"]
    assert own == [("全文整合单中心卡", 0.82), ("转折后重心卡", 0.79), ("结尾回收卡", 0.78)]
    assert not [c for c in r.candidates if c.family == "continuation"]
    assert labels.coverage("ordering", "首尾双锚点卡")[1].startswith("missing_head") and labels.coverage("other", "x") == ("true", "")


def test_mined_terms_query(spark):
    """The registered query against plain Python, over its whole table."""
    counts = collections.defaultdict(collections.Counter)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").collect():
        for clause in re.split(r"[\W\d_]+", (r.text or "").lower()):
            if 3 <= len(clause) <= 8:
                counts[r.lang][clause] += 2
            elif len(clause) > 8:
                counts[r.lang].update(clause[i : i + n] for n in (4, 5, 6) for i in range(len(clause) - n + 1))
    for r in label_queries.mined_terms(spark, DATA).collect():
        kept = []
        for term, _ in sorted(counts[r.lang].items(), key=lambda x: (-x[1], x[0]))[: reports.RANKED]:
            if len(kept) < reports.KEPT and not any(term in k or k in term for k in kept):
                kept.append(term)
        assert r.terms == ",".join(kept)


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "card int, stable boolean")
    assert [tuple(r) for r in reports.card_coverage(spark.createDataFrame([(1, 2)], "card int, target int"), none).collect()] == [(1, 2, 0, 0, 2)]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    got = {r.id: (list(r.anchors), r.covered) for r in reports.anchors(rows, spark.createDataFrame([(9, "a"), (8, "a"), (7, "a"), (6, "a")], "sample_id long, k string"), ["k"]).collect()}
    assert got == {1: ([6, 7, 8], True), 2: ([], False)}


def test_unit_groups_query(spark):
    """The registered query against plain Python, over its whole table."""
    m = label_queries.UNIT_MARKERS
    has = lambda x, words: any(w in x for w in words)
    opens = lambda x: x.startswith(m.pronoun + m.context)
    cut = lambda x: round(max(0.0, min(1.0, x)) + 1e-9, 4)
    sents = {r.article_id: list(r.sents) for r in label_queries.segment.units(label_queries.articles(spark, DATA)).collect()}
    got = {r.article_id: r for r in label_queries.unit_groups(spark, DATA).collect()}
    assert got.keys() == {k for k, v in sents.items() if len(v) >= 6}
    for key, r in got.items():
        own = sents[key][: 6 + key % 7]
        need = len(own) - 6
        pairs = []
        for i, (a, b) in enumerate(zip(own, own[1:], strict=False)):
            s = 0.30 * opens(b) + 0.26 * has(b, m.turning + m.parallel) + 0.28 * (has(a, m.problem) and has(b, m.solution))
            s += 0.30 * any(x in a and has(b, y) for x, y in m.correlative) + 0.24 * any(x in a and has(b, y) for x, y in m.condition)
            s += 0.12 * (len(a) <= 34 and len(b) <= 34) - 0.18 * (len(a) + len(b) > 88) - 0.08 * has(b, m.closing)
            pairs.append((cut(s), i))
        pairs.sort(reverse=True)
        good = [p for p in pairs if p[0] >= 0.1]
        chosen = []
        for _, i in pairs if len(good) < need else good:
            if len(chosen) < need and all(abs(c - i) > 1 for c in chosen):
                chosen.append(i)
        if len(chosen) < need or need > len(own) // 2:
            assert r.six_md5 is None and r.grouped is None and r.strict == "group_size_not_six"
            continue
        six = [a + ("" if re.search(label_queries.units.OPEN_ENDS, a) else "，") + own[i + 1] if i in chosen else a for i, a in enumerate(own) if i - 1 not in chosen]
        import hashlib

        assert (r.six_md5, r.grouped) == (hashlib.md5("\n".join(six).encode()).hexdigest(), need)
        first = [cut(0.42 + 0.1 * (i == 0) + 0.18 * has(u, m.definition + m.problem + m.question) + 0.14 * has(u, m.beginning) - 0.26 * opens(u) - 0.22 * has(u, m.closing + m.countermeasure) - 0.16 * has(u, m.additive)) for i, u in enumerate(six)]
        last = [cut(0.32 + 0.12 * (i == 5) + 0.28 * has(u, m.closing + m.summary + m.conclusion) + 0.14 * (i == 5 and has(u, m.final)) + 0.18 * has(u, m.countermeasure) - 0.14 * has(u, m.definition + m.problem) - 0.1 * opens(u)) for i, u in enumerate(six)]
        firsts, lasts = [i for i in range(6) if first[i] >= 0.5], [i for i in range(6) if last[i] >= 0.54]
        assert (r.first_like, r.last_like) == (",".join(map(str, firsts)), ",".join(map(str, lasts)))
        local = sum(opens(b) or has(b, m.turning + m.parallel) for b in six[1:])
        assert r.n_local == local
        if 0 not in firsts:
            assert r.strict == r.weak == "first_unit_unstable"
        elif 5 not in lasts:
            assert r.strict == "last_unit_unstable"


def test_order_checks_without_a_contract(spark):
    """Limits that a contract leaves out ask for nothing; missing parts fail the checks that need them."""
    scores = {s: "0.0e0" for s in (*label_queries.validators.LEAST, "context_closure")} | {s: "9.0e0" for s in label_queries.validators.MOST}
    flags = {"has_closing": "false", "order_style": "true", "head_illegal": "true", "tail_illegal": "true", "n_material_units": "2", "answer": "CAST(NULL AS STRING)", "correct_order": "array(1, 2)", "options": "map('A', array(1, 2), 'B', array(2, 1, 3))"}
    flags |= {"analysis_orders": "CAST(NULL AS array<array<int>>)", "unit_sentences": "array(1, 1)", "roles": "CAST(array() AS array<string>)", "bindings": "CAST(array() AS array<struct<a: int, b: int>>)"}
    row = label_queries.rules.apply(spark.range(1), [scores | flags])
    r = label_queries.validators.order_checks(row, {}).first()
    assert r.failed == ["material_units", "option_sizes", "answer", "analysis"] and r.errors == ["ordering_chain_incomplete"] and r.warnings == []
    r = label_queries.validators.order_checks(row, {"sortable_unit_count": 6, "require_legal_tail": True, "max_total_penalty": 1}).first()
    assert r.errors == ["ordering_chain_incomplete", "sentence_count_mismatch", "total_penalty_above_ceiling", "illegal_tail"]


def test_review_queue_query(spark):
    """The registered query against plain Python, over its whole table; and small windows and queues."""
    rows = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey AS article_id", f"{search_queries.family('o_orderkey')} AS family", "concat('c', o_custkey % 40) AS card", "o_totalprice AS score")
    ranked = sorted(rows.collect(), key=lambda r: (-r.score, r.id))

    def queue(top_k, family_cap, card_cap):
        families, cards, seen, out = collections.Counter(), collections.Counter(), set(), []
        for r in ranked:
            if len(out) == top_k:
                break
            full = families[r.family] >= family_cap or cards[r.card] >= card_cap
            if full or (r.article_id in seen and families[r.family] >= max(1, family_cap // 2)):
                continue
            out.append(r.id)
            families[r.family] += 1
            cards[r.card] += 1
            seen.add(r.article_id)
        return (out + [r.id for r in ranked if r.id not in out])[:top_k]

    assert [r.id for r in search_queries.review_queue(spark, DATA).orderBy("place").collect()] == queue(200, 50, 8)
    for top_k, family_cap, card_cap in ((30, 3, 2), (5, 5, 1), (0, 1, 1)):
        got = search_queries.pool.diverse_queue(rows, top_k, family_cap, card_cap, window=7)
        assert [r.id for r in got.orderBy("place").collect()] == queue(top_k, family_cap, card_cap)


def test_suite(spark, tmp_path):
    rows = [(i, i % 9, "ab"[i % 2], "xy"[i % 3 == 0], i / 40, (39 - i) / 40, (i % 7) / 7, 0.5, i % 3 > 0, float(i), ("gray", "promoted", "deprecated")[i % 3], i % 2 == 0) for i in range(40)]
    names = "id int, article_id int, family string, task string, final double, readiness double, penalty double, quality double, positive boolean, age_days double, status string, stable boolean"
    current = {"recommended": 0.5, "review_readiness": 0.6, "review_penalty": 0.28, "fallback_review_score": 0.4}
    made = suite.run_suite(spark.createDataFrame(rows, names), current, [0.3, 0.6], [0.2], [0.5, 0.9], queue=5)
    suite.write_suite(made, str(tmp_path))
    read = {name: spark.read.json(f"{tmp_path}/{name}") for name in made}
    assert {r.n for r in read["backtest"].where("family is not null").collect()} == {20} and read["queue"].count() == 5 and read["thresholds"].count() == 8 and read["policies"].count() > 0
    assert {r.verdict for r in read["thresholds"].collect()} <= {"candidate_for_manual_review_only", "deprecated_leakage_too_high", "no_positive_proxy_objective_found", "review_only_policy_without_positive_selection"}

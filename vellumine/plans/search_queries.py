"""Queries of the search path, with their SQL.

Materials are orders: the customer is the article, the price the quality, the status and the
priority the state; reviews come from the priority as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import feedback, pool, search, segment
from .catalogue import PARTS, SQL_RECORDS, UNITS, articles, backtest, query, t

FAMILIES = ("title", "fill", "ordering", "summary", "continuation")
#: Family to question type.
TYPES = (("title", "main_idea"), ("summary", "main_idea"), ("fill", "sentence_fill"), ("ordering", "sentence_order"))


def family(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} % 5 = {i} THEN '{f}'" for i, f in enumerate(FAMILIES)) + " END"


#: Columns of the pool that are the same text in both engines.
PLAIN = {
    "id": "o_orderkey", "article_id": "o_custkey", "status": "CASE WHEN o_orderstatus = 'F' THEN 'promoted' ELSE 'gray' END", "release_channel": "CASE WHEN o_orderkey % 3 = 0 THEN 'gray' ELSE 'stable' END",
    "is_primary": "o_orderkey % 7 <> 0", "quality_score": "o_totalprice / 500000", "updated_at": "o_orderdate", "primary_family": family("o_orderkey"), "second_family": family("o_custkey"),
    "genre": "CASE WHEN o_custkey % 2 = 0 THEN 'essay' ELSE 'report' END", "structure": "CASE WHEN o_orderkey % 4 = 0 THEN 'parallel' ELSE 'general' END", "fit_a": "CAST(o_orderkey % 11 AS DOUBLE) / 10",
    "fit_b": "CAST(o_custkey % 13 AS DOUBLE) / 12", "text": "o_orderpriority",
}
POOL = "pool AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PLAIN.items()) + " FROM orders)"
REVIEW = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'auto_tagged' WHEN '2' THEN 'review_confirmed' WHEN '3' THEN 'review_rejected' WHEN '4' THEN 'review_pending' END"
REVIEWS = f"reviews AS (SELECT * FROM (SELECT o_orderkey AS id, {REVIEW} AS review_status FROM orders) WHERE review_status IS NOT NULL)"


def pool_of(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in PLAIN.items()))
    return rows.withColumns(
        {
            "families": F.array("primary_family", "second_family"),
            "subtypes": F.array(F.concat("primary_family", F.lit("/a")), F.concat("second_family", F.lit("/b"))),
            "fit_scores": F.create_map(F.lit("a"), F.col("fit_a"), F.lit("b"), F.col("fit_b")),
        }
    )


def reviews_of(spark, sf_dir):
    return t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{REVIEW} AS review_status").where("review_status is not null")


@query(
    f"WITH {POOL} SELECT id, primary_family, quality_score FROM pool WHERE status = 'promoted' AND release_channel = 'stable' AND genre = 'essay' AND structure = 'general'"
    " AND (primary_family || '/a' = 'fill/a' OR second_family || '/b' = 'fill/a') AND greatest(fit_a, fit_b) >= 0.5"
)
def pool_search(spark, sf_dir):
    found = search.pool_search(pool_of(spark, sf_dir), 0.5, "fill/a", status="promoted", release_channel="stable", genre="essay", structure="general", primary_family=None)
    return found.select("id", "primary_family", "quality_score")


@query(
    f"WITH {POOL} SELECT id, quality_score FROM pool WHERE is_primary AND status = 'promoted' AND release_channel = 'stable' AND (primary_family = 'fill' OR second_family = 'fill') ORDER BY quality_score DESC, updated_at DESC, id LIMIT 50"
)
def index_scan(spark, sf_dir):
    return search.index_scan(pool_of(spark, sf_dir), "fill", 50, status="promoted", release_channel="stable").select("id", "quality_score")


@query(
    f"""WITH {POOL}, {REVIEWS}, b AS (SELECT * FROM pool WHERE is_primary AND status = 'promoted' AND release_channel = 'stable' ORDER BY quality_score DESC, updated_at DESC, id LIMIT 1600)
    SELECT b.id, quality_score, review_status FROM b LEFT JOIN reviews r ON r.id = b.id WHERE (review_status IS NULL OR review_status IN ('auto_tagged', 'review_confirmed')) AND (primary_family = 'ordering' OR second_family = 'ordering')"""
)
def fallback_scan(spark, sf_dir):
    """The limit of 1,600 rows over all families is the operator's own."""
    return search.fallback_scan(pool_of(spark, sf_dir), reviews_of(spark, sf_dir), "ordering").select("id", "quality_score", "review_status")


@query(f"WITH {POOL} SELECT id, genre, structure FROM pool WHERE genre = 'report' AND structure = 'parallel' AND contains(text || chr(10) || primary_family, 'URGENT') AND contains(text || chr(10) || primary_family, 'tit')")
def front_filters(spark, sf_dir):
    return search.front_filters(pool_of(spark, sf_dir), "URGENT", "tit", "report", "parallel", ("text", "primary_family")).select("id", "genre", "structure")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND user_id = 7 ORDER BY event_id LIMIT 40")
def optional_filters(spark, sf_dir):
    """A list query of which two of four filters are asked for."""
    e = t(spark, sf_dir, "events")
    return search.equal(e, event_type="purchase", user_id=7, value=None, props=None).orderBy("event_id").limit(40).select("event_id", "event_type", "value")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def key_lookup(spark, sf_dir):
    keys = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").distinct()
    return search.by_key(t(spark, sf_dir, "documents"), "doc_id", keys).select("doc_id", "n_chars")


@query(
    f"""WITH {POOL}, {REVIEWS} SELECT pool.id, status, release_channel, review_status, NOT (status = 'promoted' AND release_channel = 'stable') OR coalesce(review_status IN ('auto_tagged', 'review_confirmed'), false) AS allowed
    FROM pool LEFT JOIN reviews USING (id)"""
)
def promotion_guard(spark, sf_dir):
    requests = pool_of(spark, sf_dir).select("id", "status", "release_channel")
    return search.promotion_verdicts(requests, reviews_of(spark, sf_dir))


@query("SELECT o_orderkey AS id, c_mktsegment AS domain, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def materials_of_domain(spark, sf_dir):
    articles_ = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain"))
    return t(spark, sf_dir, "orders").join(articles_, "o_custkey").select(F.col("o_orderkey").alias("id"), "domain", F.col("o_totalprice").alias("price"))


@query("SELECT c_custkey AS article_id, count(*)::BIGINT AS n, count_if(o_orderstatus = 'F')::BIGINT AS n_promoted FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count_if(o_orderstatus = 'F') > 0")
def articles_with_promoted(spark, sf_dir):
    """Inner join with a condition on the groups; orders are aggregated before the join."""
    per = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("article_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_promoted")).where("n_promoted > 0")
    return per.join(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id")), "article_id")


@query("SELECT article_id, last FROM (SELECT c_custkey AS article_id, max(o_totalprice) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1) ORDER BY last DESC NULLS LAST, article_id LIMIT 200")
def distinct_articles_limited(spark, sf_dir):
    """Articles once each, by their best pending material, those without one last."""
    best = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("article_id")).agg(F.max("o_totalprice").alias("last"))
    all_ = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id"))
    return all_.join(best, "article_id", "left").orderBy(F.desc_nulls_last("last"), "article_id").limit(200)


_TYPES = ", ".join(f"('{a}', '{b}')" for a, b in TYPES)


@query(
    f"""WITH {POOL}, y(family, question_type) AS (VALUES {_TYPES}, ('continuation', 'continuation'), ('nothing', 'unseen')), c AS (SELECT DISTINCT id, question_type, status = 'promoted' AND release_channel = 'stable' AS stable
        FROM (SELECT id, status, release_channel, unnest([primary_family, second_family]) AS family FROM pool) JOIN y USING (family))
    SELECT question_type, count(c.id)::BIGINT AS n, count_if(coalesce(stable, false))::BIGINT AS n_stable FROM (SELECT DISTINCT question_type FROM y) q LEFT JOIN c USING (question_type) GROUP BY 1"""
)
def type_coverage(spark, sf_dir):
    types = spark.createDataFrame([*TYPES, ("continuation", "continuation"), ("nothing", "unseen")], "family string, question_type string")
    return search.type_coverage(pool_of(spark, sf_dir), types)


COUNTED = ("status", "genre", "primary_family", "structure", "release_channel")


@query(f"WITH {POOL} " + " UNION ALL ".join(f"SELECT '{c}' AS counter, {c} AS value, count(*)::BIGINT AS n FROM pool GROUP BY 2" for c in COUNTED) + " UNION ALL SELECT 'status_channel', status || ':' || release_channel, count(*)::BIGINT FROM pool GROUP BY 2")
def pool_counters(spark, sf_dir):
    pool = pool_of(spark, sf_dir).withColumn("status_channel", F.concat_ws(":", "status", "release_channel"))
    return search.counters(pool, [*COUNTED, "status_channel"])


@query(f"WITH {POOL} SELECT article_id, count(*)::BIGINT AS n FROM pool WHERE status = 'promoted' AND release_channel = 'stable' GROUP BY 1 ORDER BY n DESC, article_id LIMIT 10")
def top_articles(spark, sf_dir):
    """The ten articles with most promoted stable materials: a report."""
    pool = search.equal(pool_of(spark, sf_dir), status="promoted", release_channel="stable")
    return pool.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "article_id").limit(10)


_PAYLOAD = (
    "concat('{\"title\":{\"final\":', CAST(o_orderkey % 100 AS STRING), ',\"readiness\":0.5,\"penalties\":{\"x\":0.25,\"y\":', CAST(o_custkey % 4 AS STRING), '}},\"fill\":{\"task_family\":\"slot\"', "
    "CASE WHEN o_orderkey % 3 = 0 THEN ',\"final\":1.5' ELSE '' END, '}}', CASE WHEN o_orderkey % 50 = 0 THEN '}}broken' ELSE '' END)"
)


@query(
    f"""WITH {REVIEWS}, m AS (SELECT o_orderkey AS id, o_custkey AS article_id, {_PAYLOAD} AS payload FROM orders WHERE o_orderkey % 50 <> 0), f AS (SELECT id, article_id, unnest(['title', 'fill']) AS family, payload FROM m),
    x AS (SELECT *, json_extract(payload, '$.' || family) AS item FROM f)
    SELECT id, article_id, family, coalesce(item->>'$.task_family', family) AS task_family, review_status, coalesce((item->>'$.final')::DOUBLE, 0) AS final, coalesce((item->>'$.readiness')::DOUBLE, 0) AS readiness,
    coalesce((item->>'$.penalties.x')::DOUBLE, 0) + coalesce((item->>'$.penalties.y')::DOUBLE, 0) AS total_penalty, (item->>'$.final') IS NOT NULL AS has_scoring FROM x LEFT JOIN reviews USING (id)"""
)
def index_records(spark, sf_dir):
    """One record for each material and family; payloads that are no JSON give none."""
    m = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS article_id", f"CASE WHEN o_orderkey % 50 = 0 THEN '{{broken' ELSE {_PAYLOAD} END AS payload")
    return search.flatten_payload(m, reviews_of(spark, sf_dir))


@query(
    f"""WITH {POOL}, v AS (SELECT id, list_sort(list_distinct([primary_family, second_family])) AS own, CASE id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'unanimous' WHEN 2 THEN 'split' END AS vote_status,
        CASE WHEN id % 8 = 1 THEN ['ordering'] WHEN id % 8 = 5 THEN ['title', 'fill'] ELSE [] END AS voted FROM pool),
    l AS (SELECT *, list_filter(own, lambda f: f NOT IN ('title', 'fill', 'ordering')) AS other FROM v)
    SELECT id, array_to_string(CASE WHEN vote_status IS NULL OR (len(voted) = 0 AND vote_status = 'error') THEN own ELSE list_sort(list_distinct(list_concat(other, voted))) END, ',') AS landed FROM l"""
)
def landed_families(spark, sf_dir):
    pool = pool_of(spark, sf_dir).select("id", "families")
    voted = "CASE WHEN id % 8 = 1 THEN array('ordering') WHEN id % 8 = 5 THEN array('title', 'fill') ELSE CAST(array() AS array<string>) END AS voted"
    votes = pool.where("id % 4 <> 3").selectExpr("id", "CASE id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'unanimous' ELSE 'split' END AS vote_status", voted)
    return search.landed_families(pool, votes, ("title", "fill", "ordering")).select("id", F.array_join("landed", ",").alias("landed"))


KEPT = {"penalty": ("likely_high_signal", "common_repairable_risk", "possible_over_penalization"), "threshold": ("likely_too_strict", "likely_reasonable"), "preference": ("safe_preference_shift", "borderline_shift", "unsafe_shift")}
_DIAGNOSES = {k: f"CASE WHEN {x} < 0.25 THEN '{v[0]}' WHEN {x} < 0.4 THEN '{v[-1]}' WHEN {x} < 0.5 THEN '{v[1]}' ELSE 'mixed' END" for (k, v), x in zip(KEPT.items(), ("l_discount * 5", "l_tax * 6", "(l_quantity - 1) / 50"), strict=True)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS type, name, diagnosis FROM (SELECT CAST(l_partkey AS STRING) AS name, {d} AS diagnosis FROM lineitem) WHERE diagnosis <> 'mixed'" for k, d in _DIAGNOSES.items()))
def recommendations(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem")
    parts = [x.selectExpr("CAST(l_partkey AS STRING) AS name", f"{_DIAGNOSES[k]} AS diagnosis") for k in ("penalty", "threshold", "preference")]
    return search.recommendations(*parts, KEPT)


@query(
    f"""WITH {SQL_RECORDS}, p AS (SELECT grp, round(avg(final - penalty / 2), 6) AS objective, count_if(final >= 0.9)::BIGINT AS selected, round(avg(CASE WHEN positive THEN 0.0 ELSE 0.7 END), 6) AS rate FROM r GROUP BY 1)
    SELECT grp, selected, CASE WHEN objective <= 0 THEN 'no_positive_proxy_objective_found' WHEN selected = 0 THEN 'review_only_policy_without_positive_selection' WHEN rate >= 0.35 THEN 'deprecated_leakage_too_high'
    ELSE 'candidate_for_manual_review_only' END AS verdict FROM p"""
)
def policy_verdicts(spark, sf_dir):
    r = backtest(spark, sf_dir)
    p = r.groupBy("grp").agg(F.round(F.avg(F.col("final") - F.col("penalty") / 2), 6).alias("objective"), F.count_if(F.col("final") >= 0.9).alias("selected"), F.round(F.avg(F.when(F.col("positive"), 0.0).otherwise(0.7)), 6).alias("rate"))
    return p.select("grp", "selected", search.apply_verdict(F.col("objective"), F.col("selected"), F.col("rate")).alias("verdict"))


_BLANKED = "CASE WHEN doc_id % 5 = 0 THEN text ELSE substr(text, 1, CAST(doc_id % 97 AS INT)) || CASE WHEN doc_id % 5 = 1 THEN '____' WHEN doc_id % 5 = 2 THEN '[BLANK]' ELSE '( )' END || substr(text, CAST(doc_id % 97 AS INT) + 1, 60) END"


@query(
    rf"""WITH b AS (SELECT doc_id, regexp_replace(coalesce({_BLANKED}, ''), '^\s+|\s+$', '', 'g') AS body FROM documents), p AS (SELECT *, coalesce(nullif(strpos(body, '____'), 0), nullif(strpos(body, '___'), 0), nullif(strpos(body, '[BLANK]'), 0),
        nullif(strpos(body, '（  ）'), 0), nullif(strpos(body, '( )'), 0)) - 1 AS place FROM b)
    SELECT doc_id, CASE WHEN place IS NULL THEN '' WHEN place / greatest(length(body), 1) <= 0.22 THEN 'opening' WHEN place / greatest(length(body), 1) >= 0.70 THEN 'ending' ELSE 'middle' END AS blank_position FROM p"""
)
def blank_positions(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", search.blank_position(F.expr(_BLANKED)).alias("blank_position"))


@query(
    """WITH a AS (SELECT event_id AS item, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'discard' WHEN 'view' THEN 'minor_edit' WHEN 'click' THEN 'text_modify' ELSE 'confirm' END AS action,
        CASE WHEN value < 50 THEN 'approved' WHEN value < 90 THEN 'pending_review' ELSE 'discarded' END AS result_status FROM events), f AS (SELECT *, action IN ('minor_edit', 'text_modify') AS repair FROM a)
    SELECT action, result_status, count(*)::BIGINT AS n, count_if(action IN ('approve', 'confirm') AND result_status = 'approved')::BIGINT AS accepted, count_if(repair AND result_status IN ('pending_review', 'approved'))::BIGINT AS kept,
    count_if(action = 'discard' OR result_status = 'discarded')::BIGINT AS discarded, count_if(repair)::BIGINT AS repaired FROM f GROUP BY ALL"""
)
def feedback_outcomes(spark, sf_dir):
    action = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'discard' WHEN 'view' THEN 'minor_edit' WHEN 'click' THEN 'text_modify' ELSE 'confirm' END AS action"
    a = t(spark, sf_dir, "events").selectExpr("event_id AS item", action, "CASE WHEN value < 50 THEN 'approved' WHEN value < 90 THEN 'pending_review' ELSE 'discarded' END AS result_status")
    n = lambda c, name: F.count_if(c).alias(name)
    return search.feedback_outcomes(a).groupBy("action", "result_status").agg(F.count(F.lit(1)).alias("n"), n("accepted_as_is", "accepted"), n("revised_then_kept", "kept"), n("discarded", "discarded"), n("repair_path_taken", "repaired"))


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS item, 'tax' AS check_name, l_tax > 0.02 AS required, l_tax > 0.05 AS passed, ' ' AS reason, l_tax AS actual, 0.05::DOUBLE AS threshold FROM lineitem
        UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'discount', true, l_discount < 0.04, 'too_cheap', CASE WHEN l_linenumber > 3 THEN l_discount END, NULL FROM lineitem)
    SELECT item, check_name, CASE WHEN trim(reason) = '' THEN check_name ELSE reason END AS threshold_name, actual, threshold FROM c WHERE required AND NOT passed AND (actual IS NOT NULL OR threshold IS NOT NULL)"""
)
def failed_checks(spark, sf_dir):
    check = lambda required, passed, reason, actual, threshold: f"named_struct('required', {required}, 'passed', {passed}, 'reason', {reason}, 'actual', {actual}, 'threshold', {threshold})"
    tax, discount = check("l_tax > 0.02", "l_tax > 0.05", "' '", "l_tax", "0.05e0"), check("true", "l_discount < 0.04", "'too_cheap'", "CASE WHEN l_linenumber > 3 THEN l_discount END", "CAST(NULL AS DOUBLE)")
    return search.failed_checks(t(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS item", f"map('tax', {tax}, 'discount', {discount}) AS checks"))


_OLD = ("CASE WHEN o_orderkey % 2 = 0 THEN 'a' END", "CASE WHEN o_orderkey % 3 = 0 THEN 'b' END", "'c'")
_NEW = ("CASE WHEN o_custkey % 2 = 0 THEN 'a' END", "'b'", "CASE WHEN o_custkey % 5 > 0 THEN 'd' END")


@query(
    f"""WITH k AS (SELECT o_orderkey AS id, list_filter([{', '.join(_OLD)}], lambda x: x IS NOT NULL) AS old, list_filter([{', '.join(_NEW)}], lambda x: x IS NOT NULL) AS new FROM orders)
    SELECT id, array_to_string(list_filter(new, lambda x: NOT list_contains(old, x)), ',') AS keys_added, array_to_string(list_filter(old, lambda x: NOT list_contains(new, x)), ',') AS keys_lost FROM k"""
)
def payload_changes(spark, sf_dir):
    as_map = lambda keys: f"transform(filter(array({', '.join(keys)}), x -> x is not null), x -> named_struct('key', x, 'value', 1))"
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"map_from_entries({as_map(_OLD)}) AS old", f"map_from_entries({as_map(_NEW)}) AS rebuilt")
    return search.key_changes(rows).select("id", F.array_join("keys_added", ",").alias("keys_added"), F.array_join("keys_lost", ",").alias("keys_lost"))


CARDS = [("c0", {"tone": "plain", "depth": "low"}), ("c1", {"tone": "formal"})]
STRATEGIES = [("c0", 1, ["urgent"], {"tone": "brisk"}), ("c0", 2, ["urgent", "old"], {"tone": "dry", "depth": "high"}), ("c1", 1, [], {"tone": "never"}), ("c1", 2, ["old"], {"depth": "mid"})]


@query(
    """WITH x AS (SELECT o_orderkey AS id, 'c' || (o_orderkey % 2) AS card, o_orderpriority = '1-URGENT' AS urgent, o_custkey % 3 = 0 AS old FROM orders)
    SELECT id, card, CASE WHEN card = 'c1' THEN 'formal' WHEN urgent AND old THEN 'dry' WHEN urgent THEN 'brisk' ELSE 'plain' END AS tone,
    CASE WHEN card = 'c1' THEN CASE WHEN old THEN 'mid' END WHEN urgent AND old THEN 'high' ELSE 'low' END AS depth, CASE WHEN card = 'c1' THEN old::INT ELSE urgent::INT + (urgent AND old)::INT END AS n_matched FROM x"""
)
def slot_projection(spark, sf_dir):
    conditions = "filter(array(CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_custkey % 3 = 0 THEN 'old' END), x -> x is not null) AS conditions"
    context = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('c', o_orderkey % 2) AS card", conditions)
    cards = spark.createDataFrame(CARDS, "card string, slots map<string, string>")
    strategies = spark.createDataFrame(STRATEGIES, "card string, place int, needs array<string>, slots map<string, string>")
    out = search.projected_slots(cards, context, strategies)
    return out.select("id", "card", F.col("slots")["tone"].alias("tone"), F.try_element_at("slots", F.lit("depth")).alias("depth"), "n_matched")


PATTERNS = [("p1", 1, "prio", ["1-URGENT", "2-HIGH"]), ("p1", 1, "state", ["F"]), ("p2", 2, "state", ["F", "O"]), ("p3", 3, "prio", ["1-URGENT"]), ("p3", 3, "half", ["0"])]


@query(
    """WITH s AS (SELECT o_orderkey AS id, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT + (o_orderstatus = 'F')::INT AS a, (o_orderstatus IN ('F', 'O'))::INT AS b, (o_orderpriority = '1-URGENT')::INT + (o_custkey % 2 = 0)::INT AS c FROM orders),
    r AS (SELECT id, CASE WHEN a >= b AND a >= c THEN 'p1' WHEN b >= c THEN 'p2' ELSE 'p3' END AS pattern, list_reverse(list_sort([a, b, c])) AS o FROM s)
    SELECT id, pattern, o[1] AS score, o[2] AS second_score, o[1] > 0 AND o[1] <> o[2] AS clear FROM r"""
)
def pattern_choices(spark, sf_dir):
    rules = spark.createDataFrame(PATTERNS, "pattern string, place int, slot string, allowed array<string>")
    slots = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "map('prio', o_orderpriority, 'state', o_orderstatus, 'half', CAST(o_custkey % 2 AS STRING)) AS slots")
    return search.pattern_choice(rules, slots)


RANGES = {"complexity": (0.3, 0.7), "ambiguity": (0.0, 0.5)}


@query(
    """WITH p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0.8 WHEN 'O' THEN 0.5 ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 0.1 ELSE 0.3 END END::DOUBLE AS complexity, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.6 ELSE 0.2 END::DOUBLE AS ambiguity FROM orders)
    SELECT *, concat_ws(',', CASE WHEN complexity < 0.3::DOUBLE OR complexity > 0.7::DOUBLE THEN 'complexity' END, CASE WHEN ambiguity > 0.5::DOUBLE THEN 'ambiguity' END) AS deviations, complexity BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AND ambiguity <= 0.5::DOUBLE AS in_range FROM p"""
)
def difficulty_fit(spark, sf_dir):
    slots = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "map('prio', o_orderpriority, 'state', o_orderstatus) AS slots")
    rows = slots.select(
        "id", search.projected_difficulty(F.col("slots"), 0.3, [("prio", {"1-URGENT": 0.1}), ("state", {"F": 0.8, "O": 0.5})]).alias("complexity"), search.projected_difficulty(F.col("slots"), 0.2, [("prio", {"1-URGENT": 1.4, "2-HIGH": 0.6})]).alias("ambiguity")
    )
    return search.difficulty_fit(rows, RANGES).withColumn("deviations", F.array_join("deviations", ","))


_SIGNED = r"list_transform(sents, lambda u: regexp_replace(lower(u), '[^\p{L}0-9]+', '', 'g'))"


@query(
    f"""WITH {UNITS}, g AS (SELECT article_id, {_SIGNED} AS sg FROM u) SELECT article_id, len(list_filter(range(2, len(sg) + 1), lambda i: length(sg[i - 1]) >= 12 AND length(sg[i]) >= 12 AND (contains(sg[i - 1], sg[i]) OR contains(sg[i], sg[i - 1]))))::BIGINT AS n_stitched FROM g"""
)
def stitched_units(spark, sf_dir):
    cut = segment.units(articles(spark, sf_dir))
    return cut.select("article_id", F.size(search.stitched_pairs(F.col("sents"))).cast("bigint").alias("n_stitched"))


@query()
def repeated_units(spark, sf_dir):
    """Each unit is held against the ones kept before it, in order; a test holds the query against plain Python."""
    cut = segment.units(articles(spark, sf_dir))
    return cut.select("article_id", F.size("sents").alias("n_units"), search.repeated_units(F.col("sents")).alias("n_repeated"))


@query(
    rf"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines FROM documents),
    k AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: lines[i] <> '' AND length(lines[i]) > 40)[1] AS place FROM l)
    SELECT doc_id, md5(CASE WHEN place IS NULL THEN '' ELSE regexp_replace(regexp_replace(array_to_string(lines[place:], chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '\s+$', '') END) AS clean_md5 FROM k"""
)
def leading_boilerplate(spark, sf_dir):
    """Texts without their leading run of short lines."""
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(search.without_leading_boilerplate(F.coalesce("text", F.lit("")), "^.{1,40}$")).alias("clean_md5"))


@query(
    """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, list_filter([{'k': 'discount', 'v': round(l_discount, 4)}, {'k': 'quantity', 'v': round(l_quantity / 100, 4)}, {'k': 'tax', 'v': round(l_tax, 4)}], lambda e: e.v > 0) AS e FROM lineitem),
    s AS (SELECT id, list_sort(list_transform(e, lambda x: {'b': -x.v, 'k': x.k}))[1:2] AS top FROM p) SELECT id, array_to_string(list_transform(top, lambda x: x.k), ',') AS largest FROM s"""
)
def largest_penalties(spark, sf_dir):
    """The two largest entries above 0 of a map."""
    x = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "map('discount', round(l_discount, 4), 'quantity', round(l_quantity / 100, 4), 'tax', round(l_tax, 4)) AS scores")
    return x.select("id", F.array_join(F.transform(T.top_entries(F.col("scores"), 2), lambda e: e["key"]), ",").alias("largest"))


@query("SELECT penalty, count(*)::BIGINT AS n FROM (SELECT unnest(['tax', 'discount']) AS penalty, unnest([l_tax, l_discount]) AS value FROM lineitem) WHERE value > 0 GROUP BY 1 ORDER BY n DESC, penalty LIMIT 5")
def top_penalties(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.explode(F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))).alias("penalty", "value")).where("value > 0")
    return x.groupBy("penalty").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "penalty").limit(5)


@query(
    """WITH p AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'O') AS stable, count_if(o_orderstatus = 'O' AND o_totalprice > 200000) AS effective FROM orders GROUP BY 1)
    SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'zero_material' WHEN stable = 0 THEN 'gray_only' WHEN effective = 0 THEN 'stable_no_effective' ELSE 'effective' END AS bucket, count(*)::BIGINT AS n FROM customer LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1"""
)
def conversion_buckets(spark, sf_dir):
    """Articles by how far their materials came, in four buckets."""
    stable = F.col("o_orderstatus") == "O"
    per = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stable).alias("stable"), F.count_if(stable & (F.col("o_totalprice") > 200000)).alias("effective"))
    rows = t(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0)
    bucket = F.when(F.col("n") == 0, "zero_material").when(F.col("stable") == 0, "gray_only").when(F.col("effective") == 0, "stable_no_effective").otherwise("effective")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {POOL}, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN ['title'] WHEN id % 3 = 1 THEN ['fill', 'ordering'] ELSE [] END AS asked, [primary_family, second_family] AS own FROM pool)
    SELECT id, array_to_string(list_filter(asked, lambda x: list_contains(own, x)), ',') AS shared, len(list_filter(asked, lambda x: list_contains(own, x))) > 0 AS served, array_to_string(list_filter(list_concat([own[1]], CASE WHEN own[2] <> own[1] THEN [own[2]] ELSE [] END), lambda x: true), ',') AS families FROM r"""
)
def requested_families(spark, sf_dir):
    """What is asked for and what a material has: intersection, overlap, and the ordered distinct list."""
    asked = F.expr("CASE WHEN id % 3 = 0 THEN array('title') WHEN id % 3 = 1 THEN array('fill', 'ordering') ELSE CAST(array() AS array<string>) END")
    rows = pool_of(spark, sf_dir).select("id", "families", asked.alias("asked"))
    return rows.select("id", F.array_join(F.array_intersect("asked", "families"), ",").alias("shared"), F.arrays_overlap("asked", "families").alias("served"), F.array_join(F.array_distinct("families"), ",").alias("families"))


@query(
    f"""WITH {UNITS}, w AS (SELECT article_id, 'whole_passage' AS kind, 0 AS start, len(paras) AS size, array_to_string(paras, chr(10) || chr(10)) AS text FROM u WHERE len(paras) BETWEEN 1 AND 8 AND n_chars <= 1600
        UNION ALL SELECT article_id, kind, i - 1, least(z, len(paras) - i + 1), array_to_string(paras[i:i + z - 1], chr(10) || chr(10)) FROM (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM u), (VALUES ('closed_span', 1), ('closed_span', 2), ('multi_paragraph_unit', 2), ('multi_paragraph_unit', 3)) k(kind, z)
            WHERE CASE kind WHEN 'closed_span' THEN length(array_to_string(paras[i:i + z - 1], chr(10) || chr(10))) >= 90 ELSE least(z, len(paras) - i + 1) >= 2 AND length(array_to_string(paras[i:i + z - 1], chr(10) || chr(10))) BETWEEN 140 AND 1200 END
        UNION ALL SELECT article_id, 'insertion_context_unit', i - 1, least(3, len(sents) - i + 1), array_to_string(sents[i:i + 2], '') FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM u) WHERE least(3, len(sents) - i + 1) >= 2)
    SELECT article_id, kind, start::INT AS start, size::INT AS size, md5(text) AS text_md5 FROM w QUALIFY row_number() OVER (PARTITION BY article_id, kind, text ORDER BY start, size) = 1"""
)
def rule_candidates(spark, sf_dir):
    return segment.rule_candidates(articles(spark, sf_dir)).select("article_id", "kind", "start", "size", F.md5("text").alias("text_md5"))


@query()
def adapted_windows(spark, sf_dir):
    """A window grows step by step, each step by what the one before has left; a test holds the query against plain Python."""
    cut = segment.units(articles(spark, sf_dir)).where("size(sents) > 0")
    middle = F.floor(F.size("sents") / 2).cast("int")
    grown = segment.adapted(cut.withColumns({"first": middle, "last": middle}), 400, 60)
    return grown.select("article_id", "first", "last")


@query(
    """WITH a AS (SELECT doc_id AS id, sha256(text) AS hash, doc_id % 7 AS updated_at, doc_id % 11 AS created_at FROM documents WHERE text IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY updated_at DESC, id DESC) AS r,
    min(created_at) OVER (PARTITION BY hash) AS earliest, count(*) OVER (PARTITION BY hash) AS n FROM a) SELECT hash, id, updated_at, earliest AS created_at, n FROM l WHERE r = 1"""
)
def asset_upsert(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id AS id", "text", "doc_id % 7 AS updated_at", "doc_id % 11 AS created_at")
    return pool.asset_upsert(rows)


@query(
    f"""WITH {UNITS}, p AS (SELECT article_id, unnest(range(1, len(paras) + 1)) AS i, paras FROM u),
    k AS (SELECT article_id, i, len({PARTS.format(r"regexp_replace(regexp_replace(paras[i], '([。！？!?.])', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')")}) AS n FROM p)
    SELECT article_id, (i - 1)::INT AS paragraph, (sum(n) OVER w - n)::INT AS first, (sum(n) OVER w - 1)::INT AS last FROM k WHERE n > 0 WINDOW w AS (PARTITION BY article_id ORDER BY i)"""
)
def paragraph_bounds(spark, sf_dir):
    return segment.paragraph_bounds(articles(spark, sf_dir))


_FIELDS = {"material": "o_custkey % 3", "difficulty": "o_orderstatus", "prompt": "substr(o_orderpriority, 1, 1)", "stem": "o_orderkey % 4 = 0", "options": "floor(o_totalprice / 100000)", "analysis": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 END"}


@query(
    f"WITH v AS (SELECT o_orderkey AS version, {', '.join(f'{e} AS {n}' for n, e in _FIELDS.items())} FROM orders) SELECT v.version, {', '.join(f'v.{n} IS DISTINCT FROM p.{n} AS {n}_changed' for n in _FIELDS)}, "
    f"concat_ws(',', {', '.join(f'CASE WHEN v.{n} IS DISTINCT FROM p.{n} THEN {n!r} END' for n in _FIELDS)}) AS changed FROM v JOIN v p ON p.version = v.version - 1"
)
def version_changes(spark, sf_dir):
    """The six fields of a version against its parent's."""
    v = t(spark, sf_dir, "orders").selectExpr("1 AS item", "o_orderkey AS version", "o_orderkey - 1 AS parent_version", *(f"{e} AS {n}" for n, e in _FIELDS.items()))
    return feedback.version_diff(v, list(_FIELDS)).select("version", *(f"{n}_changed" for n in _FIELDS), "changed")


@query()
def review_queue(spark, sf_dir):
    """Two hundred candidates under caps: a report.  Each choice depends on those before; a test holds it against plain Python."""
    orders = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS article_id", f"{family('o_orderkey')} AS family", "concat('c', o_custkey % 40) AS card", "o_totalprice")
    return pool.diverse_queue(orders.withColumnRenamed("o_totalprice", "score"), 200, 50, 8).select("id", "family", "card", "place")

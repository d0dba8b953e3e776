"""Registered queries and their SQL.

Inputs play these parts: ``documents`` are articles, ``labels`` review states (quality 1
confirmed, 0 rejected, none missing), ``events`` usage and feedback (purchase accepted, error
bad case), ``conversations`` versions, and the order tables carry scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import dedupe, evaluate, feedback, genre, pool, profile, reports, review, segment
from ..streaming import state

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "lang", "text")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("span_id"), "lang", "text")


# SQL pieces that oracles share -----------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
BODY = STRIP.format(r"regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))
PARTS = r"list_filter(list_transform(string_split({0}, chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
PARAS = PARTS.format(r"regexp_replace(body, '\n+', chr(1), 'g')")
SENTS = PARTS.format(r"regexp_replace(regexp_replace(body, '([。！？!?.])', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')")
WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}0-9]+'), lambda w: w <> '')"
UNITS = f"u AS (SELECT doc_id AS article_id, lang, body, length(body) AS n_chars, {PARAS} AS paras, {SENTS} AS sents FROM (SELECT *, {BODY} AS body FROM documents))"
HAY = "' ' || array_to_string(" + WORDS + ", ' ') || ' '"


def sql_any(hay: str, group: str, test: str = "contains") -> str:
    """Whether the searched text has a marker of the group."""
    cases = " ".join(
        "WHEN '{}' THEN {}".format(lang, " OR ".join(f"{test}({hay}, '{L.padded(lang, m)}')" for m in pack[group])) for lang, pack in L.PACKS.items()
    )
    return f"coalesce(CASE lang {cases} END, false)"


def sql_sum(group: str, item: str) -> str:
    cases = " ".join(
        "WHEN '{}' THEN {}".format(lang, " + ".join(item.format(m=L.padded(lang, m), n=len(L.padded(lang, m))) for m in pack[group]))
        for lang, pack in L.PACKS.items()
    )
    return f"coalesce(CASE lang {cases} END, 0)"


# Text and segmentation -------------------------------------------------------------------


@query(
    f"""WITH h AS (SELECT lang, {HAY.format("coalesce(text, '')")} AS hay FROM documents),
    c AS (SELECT lang, {sql_sum("summary", "((length(hay) - length(replace(hay, '{m}', ''))) // {n})")} AS n FROM h),
    s AS (SELECT lang, round(least(1.0, n * 0.18::DOUBLE + CASE WHEN n > 0 THEN 0.30::DOUBLE ELSE 0 END), 4)::DOUBLE AS strength FROM c)
    SELECT lang, count(*)::BIGINT AS n_docs, round(avg(strength), 6) AS mean_strength,
           round(quantile_cont(strength, 0.75), 6) AS p75_strength, count_if(strength > 0)::BIGINT AS n_marked
    FROM s GROUP BY lang"""
)
def marker_strength_by_lang(spark, sf_dir):
    """Strength of summary markers: mean and upper quartile by language."""
    docs = t(spark, sf_dir, "documents").select("lang", T.haystack(F.coalesce("text", F.lit("")), F.col("lang")).alias("hay"))
    strength = T.marker_strength(L.occurrences(F.col("hay"), F.col("lang"), "summary"))
    return docs.select("lang", strength.alias("s")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("s"), 6).alias("mean_strength"),
        F.round(F.percentile("s", F.lit(0.75)), 6).alias("p75_strength"),
        F.count_if(F.col("s") > 0).alias("n_marked"),
    )


@query(f"SELECT doc_id, length({BODY})::BIGINT AS n_clean, sha256({BODY}) AS content_hash FROM documents")
def clean_text_len(spark, sf_dir):
    body = T.clean(F.coalesce("text", F.lit("")))
    return t(spark, sf_dir, "documents").select("doc_id", F.length(body).cast("bigint").alias("n_clean"), T.content_hash(body).alias("content_hash"))


@query(f"WITH {UNITS} SELECT article_id, len(paras)::BIGINT AS n_paragraphs, len(sents)::BIGINT AS n_sentences, coalesce(list_max(list_transform(sents, lambda s: length(s))), 0)::BIGINT AS longest FROM u")
def sentence_counts(spark, sf_dir):
    return segment.units(articles(spark, sf_dir)).select(
        "article_id",
        F.size("paras").cast("bigint").alias("n_paragraphs"),
        F.size("sents").cast("bigint").alias("n_sentences"),
        F.coalesce(F.array_max(F.transform("sents", lambda s: F.length(s))), F.lit(0)).cast("bigint").alias("longest"),
    )


def _sql_windows(items: str, low: int, high: int, glue: str, kind: str) -> str:
    return f"""SELECT article_id, n_chars, len(sents) AS n_sents, '{kind}' AS kind, start, size,
        array_to_string({items}[start + 1 : start + size], {glue}) AS text
        FROM u, (SELECT unnest(range({low}, {high + 1})) AS size), LATERAL (SELECT unnest(range(0, len({items}) - size + 1)) AS start)"""


def _shown(spans: DataFrame) -> DataFrame:
    return spans.select(
        "article_id", "kind", F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


SHOW = "article_id, kind, start::BIGINT AS start, size::BIGINT AS size, md5(text) AS text_md5, length(text)::BIGINT AS n_chars"
SQL_PARAGRAPHS = f"{_sql_windows('paras', 1, 1, 'chr(10) || chr(10)', 'paragraph')} UNION ALL {_sql_windows('paras', 2, 3, 'chr(10) || chr(10)', 'paragraph_window')}"
SQL_SENTENCES = _sql_windows("sents", 3, 6, "''", "sentence_group")


@query(f"WITH {UNITS} SELECT {SHOW} FROM ({SQL_PARAGRAPHS})")
def paragraph_windows(spark, sf_dir):
    return _shown(segment.paragraph_windows(articles(spark, sf_dir)))


@query(f"WITH {UNITS} SELECT {SHOW} FROM ({SQL_SENTENCES})")
def sentence_windows(spark, sf_dir):
    return _shown(segment.sentence_windows(articles(spark, sf_dir)))


@query(
    f"""WITH {UNITS}, s AS ({SQL_PARAGRAPHS} UNION ALL {SQL_SENTENCES}
    UNION ALL SELECT * FROM ({_sql_windows('paras', 3, 3, 'chr(10) || chr(10)', 'story_fragment')}) WHERE start = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY article_id, kind ORDER BY size, start) AS rank FROM s)
    SELECT {SHOW} FROM r WHERE NOT (n_sents <= 8 OR n_chars <= 1200) OR rank <= CASE kind WHEN 'paragraph' THEN 4
        WHEN 'paragraph_window' THEN 2 WHEN 'sentence_group' THEN 1 WHEN 'story_fragment' THEN CASE WHEN n_sents >= 6 THEN 1 ELSE 0 END END"""
)
def throttled_spans(spark, sf_dir):
    return _shown(segment.throttled(articles(spark, sf_dir)))


@query(
    f"""WITH {UNITS} SELECT article_id, (i - 1)::BIGINT AS sentence_index, md5(sents[i]) AS sentence_md5
    FROM u, LATERAL (SELECT unnest(range(1, len(sents) + 1)) AS i)"""
)
def numbered_sentences(spark, sf_dir):
    out = segment.numbered_sentences(articles(spark, sf_dir))
    return out.select("article_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), F.md5("sentence").alias("sentence_md5"))


@query(
    """WITH h AS (SELECT doc_id AS id, source AS url, sha256(text) AS hash FROM documents WHERE text IS NOT NULL),
    f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1)
    SELECT id, url, hash FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1"""
)
def content_hash_dedupe(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), "text")
    return pool.ingest_dedupe(rows).select("id", "url", "hash")


@query(
    rf"""WITH d AS (SELECT doc_id, list_distinct({WORDS.format("coalesce(text, '')")}) AS w FROM documents),
    b AS (SELECT item_id, list_distinct({WORDS.format("coalesce(text, '')")}) AS w FROM benchmark),
    x AS (SELECT doc_id, unnest(w) AS w FROM d), y AS (SELECT item_id, unnest(w) AS w, len(w) AS n FROM b),
    s AS (SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS n FROM x JOIN y USING (w) GROUP BY ALL)
    SELECT doc_id, item_id, shared::BIGINT AS shared, round(shared / n, 4) AS support FROM s
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared / n DESC, item_id) = 1"""
)
def token_overlap_vs_benchmark(spark, sf_dir):
    """The reference item whose words a document covers best."""
    own = F.array_distinct(T.words(F.coalesce("text", F.lit(""))))
    return reports.nearest_items(t(spark, sf_dir, "documents").select("doc_id", own.alias("words")), t(spark, sf_dir, "benchmark").select("item_id", own.alias("words")))


# Profiles and gates ----------------------------------------------------------------------

FLAGS = ("summary", "turn", "example", "problem", "method", "enumeration", "value", "open_ending", "cause", "carry", "restate", "unique", "phenomenon", "parallel", "middle", "tail")
SIGNALS = (
    f"b AS (SELECT doc_id AS span_id, lang, {STRIP.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS body FROM documents), "
    f"u AS (SELECT span_id, lang, body, length(body) AS n, greatest(1, len({PARAS})) AS p, greatest(1, len({SENTS})) AS s, "
    f"{HAY.format('body')} AS hay, {HAY.format('right(body, 24)')} AS tail FROM b), "
    "g AS (SELECT *, " + ", ".join(f"{sql_any('hay', x)} AS has_{x}" for x in FLAGS)
    + ", " + ", ".join(f"{sql_any('hay', x, 'starts_with')} AS starts_{x}" for x in ("context_start", "soft_start", "opening"))
    + f", {sql_sum('sequence', 'contains(hay, {q}{{m}}{q})::INT'.format(q=chr(39)))} AS sequence_count, {sql_any('tail', 'summary')} AS tail_summary"
    + r""", regexp_matches(body, '[.。！？!?]$|[.。！？!?][”"]$|】$') AS terminal, p >= 2 AND s >= 5 AS complete FROM u)"""
)


def _w(test: str, x: float) -> str:
    return f"CASE WHEN {test} THEN {x}::DOUBLE ELSE 0::DOUBLE END"


def _pick(test: str, yes: float, no: float) -> str:
    return f"CASE WHEN {test} THEN {yes}::DOUBLE ELSE {no}::DOUBLE END"


PROFILE = SIGNALS + f""", f AS (SELECT *,
    has_enumeration::INT * 2 + has_summary::INT + has_turn::INT + starts_opening::INT + has_middle::INT + has_open_ending::INT AS role_count,
    has_enumeration::INT + has_summary::INT + has_turn::INT + has_problem::INT + has_method::INT + has_cause::INT + has_carry::INT AS relation_count,
    CASE WHEN n > 500 THEN 'long' WHEN n > 180 THEN 'medium' ELSE 'short' END AS length_bucket,
    least(0.92::DOUBLE, 0.35::DOUBLE + {_w('has_summary', .18)} + {_w('complete', .16)} + {_w('n >= 260', .1)}) AS center,
    least(0.92::DOUBLE, 0.30::DOUBLE + {_w('has_summary', .35)} + {_w('complete', .18)} + {_w('n >= 260', .08)}) AS summary,
    {_pick('has_turn', .8, .25)} AS transition, {_pick('has_restate', .7, .35)} AS explanation,
    greatest(0::DOUBLE, least(0.9::DOUBLE, {_pick('has_enumeration', .72, .22)} - {_w('complete', .12)} + {_w('has_enumeration AND s <= 5', .12)})) AS anchor,
    {_pick('has_open_ending', .8, .28)} AS openness, {_pick('has_unique', .75, .38)} AS uniqueness, {_pick('has_value', .75, .3)} AS value,
    {_pick('has_example AND has_summary', .8, .22)} AS example, {_pick('has_problem', .8, .22)} AS problem, {_pick('has_method', .8, .22)} AS method,
    {_pick('has_enumeration', .72, .22)} AS branch,
    least(0.95::DOUBLE, 0.34::DOUBLE + {_w('p >= 2', .22)} + {_w('s >= 5', .16)} + {_w('n >= 220', .14)} + {_w('has_summary', .1)}) AS independence
    FROM g), pr AS (SELECT *,
    least(1::DOUBLE, 0.38::DOUBLE + center * 0.34::DOUBLE + summary * 0.18::DOUBLE + {_w('p >= 2', .12)}) AS titleability,
    CASE WHEN has_problem AND has_method THEN 'problem_solution' WHEN has_example AND has_summary THEN 'case_conclusion'
         WHEN has_turn AND has_summary THEN 'turn_conclusion' WHEN has_enumeration AND p >= 2 THEN 'parallel_progress'
         WHEN has_summary AND p >= 2 THEN 'details_summary' WHEN starts_opening AND has_value THEN 'background_conclusion'
         WHEN has_value THEN 'claim_argument' WHEN has_phenomenon THEN 'phenomenon_analysis' ELSE 'general' END AS label,
    least(0.98::DOUBLE, greatest(0::DOUBLE, greatest(0::DOUBLE, independence - {_w('starts_context_start', .22)}) - {_w('NOT terminal', .18)})) AS readability
    FROM f)"""
STRENGTHS = ("center", "summary", "transition", "explanation", "anchor", "openness", "uniqueness", "value", "example", "problem", "method", "branch", "independence", "titleability", "readability")


@query(
    f"WITH {PROFILE} SELECT span_id, length_bucket, p::BIGINT AS n_paragraphs, s::BIGINT AS n_sentences, label, role_count::BIGINT AS role_count, relation_count::BIGINT AS relation_count, "
    + ", ".join(f"round({x} + 1e-9::DOUBLE, 3) AS {x}" for x in STRENGTHS) + " FROM pr"
)
def universal_profile(spark, sf_dir):
    out = profile.profile(spans(spark, sf_dir))
    return out.select(
        "span_id", "length_bucket", F.col("p").cast("bigint").alias("n_paragraphs"), F.col("s").cast("bigint").alias("n_sentences"), "label",
        F.col("role_count").cast("bigint").alias("role_count"), F.col("relation_count").cast("bigint").alias("relation_count"), *(T.rounded(F.col(x), 3).alias(x) for x in STRENGTHS)
    )


@query(f"WITH {PROFILE} SELECT lang, label, count(*)::BIGINT AS n FROM pr GROUP BY ALL")
def structure_label_counts(spark, sf_dir):
    return profile.profile(spans(spark, sf_dir)).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


ROUTES = PROFILE + f""", c AS (SELECT *, (sequence_count >= 2)::INT + (p >= 3 AND sequence_count >= 2)::INT + (p >= 3 AND has_summary)::INT AS conditions,
    sequence_count >= 3 AND p >= 3 AND has_summary AS strong_order FROM pr), sc AS (SELECT *,
    0.32::DOUBLE * center + 0.26::DOUBLE * independence + 0.24::DOUBLE * summary + 0.08::DOUBLE * example + 0.07::DOUBLE * value + {_w('p >= 2', .08)} + {_w('s >= 5', .06)}
        - 0.10::DOUBLE * anchor - 0.12::DOUBLE * openness AS f0,
    0.36::DOUBLE * titleability + 0.24::DOUBLE * center + 0.22::DOUBLE * independence + 0.08::DOUBLE * value + 0.05::DOUBLE * example + {_w('p >= 2', .05)} - 0.10::DOUBLE * openness AS f1,
    0.26::DOUBLE * greatest(transition, explanation) + 0.18::DOUBLE * (1 - independence) + 0.16::DOUBLE * {_pick('role_count > 0', .9, .2)} + {_w('role_count >= 1', .15)}
        + {_w('relation_count >= 2', .15)} + {_w('has_parallel', .08)} - 0.12::DOUBLE * summary - 0.10::DOUBLE * center - {_w('complete', .08)} AS f2,
    0.30::DOUBLE * anchor + {_w('relation_count >= 2', .12)} + {_w('role_count >= 2', .12)} + 0.14::DOUBLE * branch - 0.10::DOUBLE * summary - 0.08::DOUBLE * independence
        + CASE WHEN conditions >= 3 THEN 0.55::DOUBLE WHEN conditions = 2 THEN 0.40::DOUBLE WHEN conditions = 1 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS f3,
    0.24::DOUBLE * openness + 0.24::DOUBLE * uniqueness + 0.12::DOUBLE * problem + 0.12::DOUBLE * method + 0.10::DOUBLE * branch + 0.08::DOUBLE * value
        + {_pick('has_summary', .12, -.1)} + {_pick('has_tail', .15, -.12)} - {_w('s < 4', .08)} - {_w('independence < 0.58', .1)} AS f4
    FROM c), rd AS (SELECT *, list_transform([f0, f1, f2, CASE WHEN strong_order THEN greatest(f3, 0.65::DOUBLE) ELSE f3 END, f4], lambda x: round(greatest(0, least(1, x)) + 1e-9::DOUBLE, 4)) AS fs FROM sc),
    rk AS (SELECT *, list_sort(list_transform(range(5), lambda i: {{'by': -fs[i + 1], 'place': i}})) AS ranked FROM rd),
    rt AS (SELECT *, -ranked[1].by AS top, -ranked[2].by AS second, ['summary', 'title', 'fill', 'ordering', 'continuation'][ranked[1].place + 1] AS family FROM rk)"""


@query(
    f"""WITH {ROUTES} SELECT span_id, round(fs[1] + 1e-9::DOUBLE, 3) AS f_summary, round(fs[2] + 1e-9::DOUBLE, 3) AS f_title, round(fs[3] + 1e-9::DOUBLE, 3) AS f_fill, round(fs[4] + 1e-9::DOUBLE, 3) AS f_ordering, round(fs[5] + 1e-9::DOUBLE, 3) AS f_continuation,
    CASE WHEN top >= 0.45 THEN family END AS primary_family, CASE WHEN top < 0.45 THEN 'reject' WHEN strong_order THEN 'gray_parallel_with_strong_ordering'
    WHEN top > 0.70 AND top - second > 0.12::DOUBLE THEN 'stable_top1' WHEN top > 0.65 AND second > 0.58 AND top - second <= 0.12::DOUBLE THEN 'gray_top2' ELSE 'gray_top1' END AS decision,
    least(4, len(list_filter(ranked, lambda x: -x.by >= 0.37::DOUBLE)))::BIGINT AS n_parallel FROM rt"""
)
def family_route(spark, sf_dir):
    out = profile.routes(spans(spark, sf_dir))
    return out.select("span_id", *(T.rounded(F.col(f"f_{f}"), 3).alias(f"f_{f}") for f in profile.FAMILIES), F.col("primary").alias("primary_family"), "decision", F.col("n_parallel").cast("bigint").alias("n_parallel"))


@query(
    f"""WITH {SIGNALS}, h AS (SELECT *, {WORDS.format("('x ' || body)")} AS ws FROM g), k AS (SELECT *, ' ' || ws[len(ws)] || ' ' AS last FROM h),
    r AS (SELECT *, list_filter([CASE WHEN NOT terminal THEN 'missing_terminal_punctuation' END,
        CASE WHEN ends_with(body, '...') OR ends_with(body, '…') THEN 'ellipsis_truncation' END,
        CASE WHEN regexp_matches(body, '[,:;、，：（(《【“]$') THEN 'trailing_fragment' END,
        CASE WHEN {sql_any('last', 'soft_start')} AND NOT terminal THEN 'half_clause_tail' END,
        CASE WHEN starts_context_start THEN 'starts_with_context_dependency' END], lambda x: x IS NOT NULL) AS hard,
        (starts_soft_start AND p <= 1) OR (n >= 420 AND p >= 4 AND NOT tail_summary) OR (n >= 260 AND s >= 5 AND NOT tail_summary) AS review FROM k),
    q AS (SELECT *, CASE WHEN len(hard) > 0 THEN array_to_string(hard, ',') WHEN review THEN 'review_deferred_gray_hold' WHEN starts_soft_start THEN 'rule_gray_hold_soft_dependency'
        WHEN NOT tail_summary AND (p >= 2 OR s >= 4) THEN 'rule_gray_hold_structural_uncertainty' ELSE 'rule_direct_allow' END AS reason FROM r)
    SELECT CASE WHEN len(hard) > 0 THEN 'reject' WHEN reason = 'rule_direct_allow' THEN 'allow' ELSE 'gray_hold' END AS status, reason, count(*)::BIGINT AS n FROM q GROUP BY ALL"""
)
def integrity_status_counts(spark, sf_dir):
    return profile.integrity(spans(spark, sf_dir)).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PROFILE} SELECT coalesce(CASE WHEN s < 3 THEN 'below_min_sentences' WHEN n < 120 THEN 'below_min_chars' WHEN independence < 0.45 THEN 'low_independence_score'
    WHEN (center + summary + explanation + problem + method + value) / 6 < 0.35 AND n < 320 THEN 'low_information_density'
    WHEN independence < 0.58 AND greatest(transition, explanation) > 0.65 AND role_count > 0 THEN 'bridge_like_fragment'
    WHEN transition > 0.7 AND starts_soft_start AND n < 220 THEN 'half_transition_fragment'
    WHEN example > 0.7 AND center < 0.55 AND summary < 0.45 THEN 'isolated_example_fragment' END, 'kept') AS reason, count(*)::BIGINT AS n FROM pr GROUP BY 1"""
)
def minimum_line_reasons(spark, sf_dir):
    return profile.minimum_line(spans(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Pool and retrieval ----------------------------------------------------------------------


def materials(spark, sf_dir):
    return t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.col("source").alias("article_id"), (F.coalesce("n_chars", F.lit(0)) / 4000.0).alias("quality"), "text"
    )


def reviews(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "review_confirmed").otherwise("review_rejected")
    return t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), status.alias("review_status"))


@query(
    """SELECT coalesce(CASE l.quality WHEN 1 THEN 'review_confirmed' WHEN 0 THEN 'review_rejected' END, 'missing_review') AS review_status,
    count(*)::BIGINT AS n, count_if(coalesce(l.quality = 1, false))::BIGINT AS strict_ok, count_if(coalesce(l.quality, 1) <> 0)::BIGINT AS relaxed_ok
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"""
)
def review_gate_counts(spark, sf_dir):
    m, r = materials(spark, sf_dir).select("id"), reviews(spark, sf_dir)
    both = pool.review_gate(m, r, True).withColumnRenamed("servable", "strict").withColumn("relaxed", F.col("review_status") != "review_rejected")
    return both.groupBy("review_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("strict_ok"), F.count_if("relaxed").alias("relaxed_ok")
    )


@query(
    """SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*)::BIGINT AS n, count(DISTINCT md5(text))::BIGINT AS n_texts
    FROM documents GROUP BY GROUPING SETS ((lang), (source), ())"""
)
def pool_stats(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("lang", "source", F.md5("text").alias("m"))
    return d.groupingSets([("lang",), ("source",), ()], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("n_texts")).select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "n_texts"
    )


@query(
    """SELECT o_orderpriority AS family, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean_score, count_if(o_totalprice < 100000)::BIGINT AS low,
    count_if(o_totalprice >= 100000 AND o_totalprice < 300000)::BIGINT AS mid, count_if(o_totalprice >= 300000)::BIGINT AS high FROM orders GROUP BY 1"""
)
def quality_bins(spark, sf_dir):
    p = F.col("o_totalprice")
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean_score"), F.count_if(p < 100000).alias("low"),
        F.count_if((p >= 100000) & (p < 300000)).alias("mid"), F.count_if(p >= 300000).alias("high"),
    )


@query("SELECT l_returnflag AS grp, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def percentiles_linear(spark, sf_dir):
    """Linear interpolation between neighbours."""
    p = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    out = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(p.alias("p"))
    return out.select("grp", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p75", "p90"))))


@query(
    """WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
    SELECT o_custkey, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS p90_nearest, CASE WHEN len(v) >= 10 THEN v[floor(len(v) * 0.9)::INT] END AS p90_audit FROM s"""
)
def percentile_nearest_rank(spark, sf_dir):
    """The two rank-picking definitions, over the bounded list of a customer's orders."""
    v = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return v.select("o_custkey", T.percentile_nearest(F.col("v"), 90).alias("p90_nearest"), T.percentile_audit(F.col("v")).alias("p90_audit"))


@query(
    """SELECT c_nationkey, count(DISTINCT c_custkey)::BIGINT AS n_customers, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(l_orderkey)::BIGINT AS n_lines
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def fanout_distinct_counts(spark, sf_dir):
    """Counts over a fan-out; each side is aggregated before it is joined."""
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("orders"), F.sum("lines").alias("lines"))
    return t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per, "c_custkey", "left").groupBy("c_nationkey").agg(
        F.count_distinct("c_custkey").alias("n_customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def fresh_keys_anti(spark, sf_dir):
    keys = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_anti")


@query("SELECT user_id, count(*)::BIGINT AS usage_count, epoch_us(max(ts))::BIGINT AS last_used_us, greatest(0, floor((epoch(TIMESTAMP '2030-01-01') - epoch(max(ts)::TIMESTAMP)) / 86400))::BIGINT AS age_days FROM events GROUP BY 1")
def usage_stats(spark, sf_dir):
    out = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("usage_count"), F.max("ts").alias("last"))
    last = F.col("last").cast("timestamp")
    return out.select("user_id", "usage_count", F.unix_micros(last).alias("last_used_us"), T.age_days(last, F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("age_days"))


REQUIREMENTS = [("long", "price", ">=", 0.5), ("long", "discount", "<=", 0.05), ("cheap", "price", "<", 0.3), ("cheap", "quantity", ">", 0.4), ("exact", "discount", "target", 0.04)]


def _signals(spark, sf_dir):
    wide = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.avg("l_extendedprice") / 100000, 6).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_quantity") / 50, 6).alias("quantity")
    )
    return wide.unpivot("id", ["price", "discount", "quantity"], "signal", "actual")


def _requirements(spark):
    return spark.createDataFrame(REQUIREMENTS, "card string, signal string, op string, value double")


SQL_CARDS = """r(card, signal, op, value) AS (VALUES {}), w AS (SELECT l_partkey AS id, round(avg(l_extendedprice) / 100000, 6) AS price,
    round(avg(l_discount), 6) AS discount, round(avg(l_quantity) / 50, 6) AS quantity FROM lineitem GROUP BY 1),
    s AS (UNPIVOT w ON price, discount, quantity INTO NAME signal VALUE actual),
    x AS (SELECT id, card, signal, CASE op WHEN '>=' THEN CASE WHEN actual >= value THEN 1.0::DOUBLE ELSE least(1, greatest(0, actual / value)) END
        WHEN '>' THEN CASE WHEN actual > value THEN 1.0::DOUBLE ELSE least(1, greatest(0, actual / value)) END
        WHEN '<=' THEN CASE WHEN actual <= value THEN 1.0::DOUBLE ELSE least(1, greatest(0, value / actual)) END
        WHEN '<' THEN CASE WHEN actual < value THEN 1.0::DOUBLE ELSE least(1, greatest(0, value / actual)) END
        ELSE least(1, greatest(0, 1 - abs(actual - value))) END AS score FROM s JOIN r USING (signal)),
    c AS (SELECT id, card, avg(score) AS score FROM x GROUP BY ALL)""".format(", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in REQUIREMENTS))


@query(f"WITH {SQL_CARDS} SELECT id, card, round(score + 1e-9::DOUBLE, 4) AS score FROM c")
def requirement_scores(spark, sf_dir):
    return pool.card_scores(_signals(spark, sf_dir), _requirements(spark)).select("id", "card", T.rounded(F.col("score"), 4).alias("score"))


@query(f"WITH {SQL_CARDS}, k AS (SELECT id, card, round(score + 1e-9::DOUBLE, 4) AS score FROM c) SELECT card, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= 5")
def card_topk(spark, sf_dir):
    scores = pool.card_scores(_signals(spark, sf_dir), _requirements(spark)).select("id", "card", T.rounded(F.col("score"), 4).alias("score"))
    return pool.top_k(scores, ["card"], [F.desc("score"), F.asc("id")], 5).select("card", "id", "score", "rank")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license') OR contains(lower(source), 'src1 ')")
def term_search(spark, sf_dir):
    return pool.term_search(t(spark, sf_dir, "documents"), ["idiot", "license", "src1 "], ("text", "source")).select("doc_id", "lang")


@query("SELECT doc_id AS id, rank::INT AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents) WHERE rank <= 50")
def newest_first(spark, sf_dir):
    """The 50 longest documents; a top-k report."""
    rows = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"))
    best = pool.newest_first(rows, 50)
    return best.select("id", F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id"))).alias("rank"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders)::BIGINT AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return pool.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query(
    """WITH f AS (SELECT lang, doc_id, md5(text) AS m, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY n_chars DESC, doc_id) = 1)
    SELECT lang, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM f)
    WHERE rank <= CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 4 WHEN 'de' THEN 4 WHEN 'es' THEN 2 ELSE 0 END"""
)
def type_topk_distinct(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", F.sha2("text", 256).alias("m"))
    return pool.top_k_distinct(rows, ["lang"], "m", [F.desc("n_chars"), F.asc("doc_id")], {"en": 8, "fr": 4, "de": 4, "es": 2}).select("lang", "doc_id", "rank")


@query(
    """WITH n AS (SELECT DISTINCT doc_id FROM labels), m AS (SELECT doc_id AS id, source AS article_id, n.doc_id IS NOT NULL AS fresh FROM documents LEFT JOIN n USING (doc_id))
    SELECT id, article_id, fresh OR NOT bool_or(fresh) OVER (PARTITION BY article_id) AS is_primary FROM m"""
)
def demote_primaries(spark, sf_dir):
    m = materials(spark, sf_dir).select("id", "article_id").withColumn("is_primary", F.lit(True))
    return pool.demote(m, reviews(spark, sf_dir).select("id").distinct()).select("id", "article_id", "is_primary")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE d.lang END AS value, coalesce(d.n_chars, l.quality)::BIGINT AS created_at
    FROM documents d FULL JOIN labels l USING (doc_id)"""
)
def upsert_latest(spark, sf_dir):
    old = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"), F.col("n_chars").alias("created_at"))
    new = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labelled").alias("value"), F.col("quality").cast("bigint").alias("created_at"))
    return pool.upsert(old, new, "id").select("id", "value", "created_at")


@query()
def diverse_selection(spark, sf_dir):
    """Greedy selection under quotas is order-dependent; tests hold it against brute force."""
    items = t(spark, sf_dir, "documents").select(
        F.col("lang").alias("query"), F.col("doc_id").alias("candidate_id"), F.col("source").alias("article_id"), F.substring("source", 1, 4).alias("source"),
        F.coalesce("n_chars", F.lit(0)).cast("double").alias("score"), "text",
    )
    return pool.diverse(items, "query", 10).select("query", "candidate_id", "place")


@query()
def near_duplicate_spans(spark, sf_dir):
    # a table may come in one piece; without a number of partitions Spark sizes them itself
    cut = segment.units(articles(spark, sf_dir).repartition("article_id"))
    return dedupe.merge_spans(cut.select("article_id", F.col("paras").alias("items")))


def _sql_words(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


URL_PATTERNS, URL_KEYWORDS = (r"/[A-Z][a-z]+", r"/\d+$"), ("Th", "Er")
SQL_URL_SCORE = rf"""(CASE WHEN regexp_matches(url, '(?:/[A-Z][a-z]+)|(?:/\d+$)') THEN 12 ELSE -8 END + CASE WHEN regexp_matches(url, '{pool.DATED}') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(url, '{pool.CONTENT}') THEN 5 ELSE 0 END
    + CASE WHEN regexp_matches(url, '{pool.DETAIL}') OR regexp_matches(lower(url), '{pool.DETAIL_LOW}') THEN 5 ELSE 0 END + CASE WHEN length(title) >= 12 THEN 3 WHEN length(title) >= 8 THEN 2 ELSE 0 END
    + CASE WHEN {_sql_words('title', URL_KEYWORDS)} THEN 5 ELSE 0 END + CASE WHEN {_sql_words('lower(url)', pool.ARTICLE_WORDS)} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '{pool.NUMBERED}') THEN 3 ELSE 0 END
    - CASE WHEN {_sql_words('lower(url)', pool.INDEX_WORDS)} THEN 10 ELSE 0 END - CASE WHEN {_sql_words('lower(title)', pool.OTHER_TITLES)} THEN 10 ELSE 0 END - CASE WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 12 ELSE 0 END)::INT"""


def _sql_normal(url: str) -> str:
    for pattern, by in (
        ("#.*$", ""), (r"^(https?://[^/?]+)(\?|$)", r"\1/\2"), (r";[^/?]*(\?|$)", r"\1"), (rf"(?i)([?&])(?:{'|'.join(pool.TRACKING)})=[^&]*", r"\1"), ("&{2,}", "&"), (r"\?&", "?"), ("[?&]$", ""),
    ):
        url = f"regexp_replace({url}, '{pattern}', '{by}', 'g')"
    return url


@query(rf"""WITH u AS (SELECT page_id, url, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages)
    SELECT page_id, {SQL_URL_SCORE} AS score, {_sql_normal("url || '?ref=x&q=1&UTM_source=y#top'")} AS normal_url FROM u""")
def url_scores(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))
    longer = F.concat("url", F.lit("?ref=x&q=1&UTM_source=y#top"))
    return p.select("page_id", pool.url_score(F.col("url"), F.col("title"), URL_PATTERNS, URL_KEYWORDS).alias("score"), pool.url_normal(longer).alias("normal_url"))


@query(
    rf"""WITH m AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>.*?</a>')) AS a FROM pages),
    x AS (SELECT page_id, url AS page, trim(regexp_replace(a, '(?is)^<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*)</a>$', '\1\2\3')) AS href,
            trim(regexp_replace(regexp_replace(regexp_replace(a, '(?is)^<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*)</a>$', '\4'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM m
        UNION ALL SELECT page_id, url, rtrim(replace(unnest(regexp_extract_all(coalesce(html, ''), '["'']((?:https?://|/)[^"''<>\s]{{6,}})["'']', 1)), '\/', '/'), ',;'), '' FROM pages),
    k AS (SELECT *, regexp_extract(page, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(page, '^(https?://[^?#]*/)', 1) AS folder FROM x WHERE NOT regexp_matches(lower(href), '^(?:javascript|mailto|tel):')
        AND NOT regexp_matches(lower(regexp_replace(href, '[?#].*$', '')), '(?:{"|".join(e.replace(".", chr(92) + ".") for e in pool.NO_PAGES)})$')),
    f AS (SELECT page_id, page, title, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(page, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN root || href
        WHEN href <> '' THEN CASE WHEN regexp_matches(folder, '^https?://$') OR folder = '' THEN root || '/' ELSE folder END || href END AS whole FROM k),
    n AS (SELECT page_id, page, title, {_sql_normal("whole")} AS url FROM f), o AS (SELECT * FROM n WHERE regexp_matches(url, '^https?://') AND regexp_extract(url, '^https?://([^/?#]+)', 1) = regexp_extract(page, '^https?://([^/?#]+)', 1)),
    b AS (SELECT page_id, url, max({{'n': length(title), 'title': title}}).title AS title FROM o GROUP BY ALL), s AS (SELECT page_id, url AS link, {SQL_URL_SCORE} AS score FROM b)
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link)::INT AS place FROM s WHERE score > 0 QUALIFY place <= 20"""
)
def discovered_links(spark, sf_dir):
    """The twenty best links of each page: a report."""
    return pool.discovered(t(spark, sf_dir, "pages").select("page_id", "url", "html"), None, URL_PATTERNS, URL_KEYWORDS)


# Feedback and evaluation -----------------------------------------------------------------


def feedback_units(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("unit"), F.col("user_id").alias("item"), F.col("event_type").alias("state"), F.col("value"),
        (F.col("event_type") == "purchase").alias("accepted"), (F.col("value") > 80).alias("revised"), (F.col("event_type") == "error").alias("discarded"),
        (F.col("event_type") != "view").alias("reviewed"),
    )


SQL_UNITS = "u AS (SELECT event_id AS unit, user_id AS item, event_type AS state, value, event_type = 'purchase' AS accepted, value > 80 AS revised, event_type = 'error' AS discarded, event_type <> 'view' AS reviewed FROM events)"


@query(
    f"""WITH {SQL_UNITS} SELECT item, count(*)::BIGINT AS n, round(count_if(accepted) / count(*), 4) AS accept_rate, round(count_if(revised) / count(*), 4) AS revise_rate,
    round(count_if(discarded) / count(*), 4) AS discard_rate, round(count_if(accepted AND reviewed) / nullif(count_if(reviewed), 0), 4) AS accept_of_reviewed FROM u GROUP BY 1"""
)
def outcome_rates(spark, sf_dir):
    return feedback.outcome_rates(feedback_units(spark, sf_dir), ["item"])


STATES = ["click", "error", "never", "purchase", "search", "view"]


@query(
    f"""WITH {SQL_UNITS}, s(state) AS (VALUES {", ".join(f"('{s}')" for s in STATES)}), o AS (SELECT *, CASE WHEN accepted THEN 'confirm' WHEN revised THEN 'modify' WHEN discarded THEN 'discard' ELSE 'other' END AS outcome FROM u)
    SELECT state, count_if(coalesce(outcome = 'confirm', false))::BIGINT AS confirm, count_if(coalesce(outcome = 'modify', false))::BIGINT AS modify, count_if(coalesce(outcome = 'discard', false))::BIGINT AS discard, count_if(coalesce(outcome = 'other', false))::BIGINT AS other
    FROM s LEFT JOIN o USING (state) GROUP BY 1"""
)
def outcome_pivot(spark, sf_dir):
    return feedback.outcome_pivot(feedback_units(spark, sf_dir), STATES)


@query(
    """WITH f AS (SELECT l_shipmode_ AS penalty, value, l_linestatus AS state, l_returnflag = 'N' AS accepted, l_returnflag = 'R' AS discarded
    FROM (SELECT *, 'tax' AS l_shipmode_, l_tax AS value FROM lineitem UNION ALL SELECT *, 'discount', l_discount FROM lineitem) WHERE value > 0)
    SELECT penalty, n, mean_value, accept_rate, discard_rate, states, CASE WHEN n < 5 THEN 'insufficient' WHEN accept_rate >= 0.6 THEN 'too_strict' WHEN discard_rate >= 0.5 THEN 'effective' ELSE 'mixed' END AS verdict
    FROM (SELECT penalty, count(*)::BIGINT AS n, round(avg(value), 4) AS mean_value, round(count_if(accepted) / count(*), 4) AS accept_rate, round(count_if(discarded) / count(*), 4) AS discard_rate,
    array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM f GROUP BY 1)"""
)
def penalty_diagnostics(spark, sf_dir):
    wide = t(spark, sf_dir, "lineitem").select(
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_linestatus").alias("state"), (F.col("l_returnflag") == "N").alias("accepted"), (F.col("l_returnflag") == "R").alias("discarded")
    )
    return feedback.penalty_diagnostics(wide.unpivot(["state", "accepted", "discarded"], ["tax", "discount"], "penalty", "value"))


@query(
    """WITH f AS (SELECT event_id AS unit, event_type AS threshold_name, value AS actual, 60.0::DOUBLE AS threshold, user_id % 3 = 0 AS accepted FROM events WHERE value < 60)
    SELECT threshold_name, count(*)::BIGINT AS n, round(avg(threshold - actual), 4) AS mean_gap, round(count_if(accepted) / count(*), 4) AS accepted_anyway,
    array_to_string(list_sort(list(DISTINCT unit))[1:5], ',') AS samples FROM f GROUP BY 1"""
)
def threshold_diagnostics(spark, sf_dir):
    f = t(spark, sf_dir, "events").where("value < 60").select(
        F.col("event_id").alias("unit"), F.col("event_type").alias("threshold_name"), F.col("value").alias("actual"), F.lit(60.0).alias("threshold"), (F.col("user_id") % 3 == 0).alias("accepted")
    )
    return feedback.threshold_diagnostics(f)


@query(
    """SELECT l_orderkey AS batch, count(*)::BIGINT AS n, count_if(l_returnflag = 'N')::BIGINT AS approved, count_if(l_returnflag = 'R')::BIGINT AS discarded, count_if(l_returnflag = 'A')::BIGINT AS revising,
    CASE WHEN count_if(l_returnflag = 'N') = count(*) THEN 'approved' WHEN count_if(l_returnflag = 'R') = count(*) THEN 'discarded' WHEN count_if(l_returnflag = 'A') > 0 THEN 'revising' ELSE 'mixed' END AS batch_status
    FROM lineitem GROUP BY 1"""
)
def batch_status_rollup(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "N", "approved").when(F.col("l_returnflag") == "R", "discarded").otherwise("revising")
    return feedback.batch_status(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), status.alias("status")))


@query(
    """SELECT c.conv_id AS item, c.turn AS version, c.role IS DISTINCT FROM p.role AS role_changed, length(c.text) IS DISTINCT FROM length(p.text) AS size_changed,
    array_to_string(list_filter([CASE WHEN c.role IS DISTINCT FROM p.role THEN 'role' END, CASE WHEN length(c.text) IS DISTINCT FROM length(p.text) THEN 'size' END], lambda x: x IS NOT NULL), ',') AS changed
    FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"""
)
def version_diff(spark, sf_dir):
    v = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.col("turn").alias("version"), (F.col("turn") - 1).alias("parent_version"), "role", F.length("text").alias("size"))
    return feedback.version_diff(v, ["role", "size"]).select("item", "version", "role_changed", "size_changed", "changed")


@query(
    """WITH r AS (SELECT o_custkey AS grp, o_orderkey AS id, o_orderstatus = 'F' AS weak, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS base_rank,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS new_rank FROM orders),
    i AS (SELECT r.*, EXISTS (SELECT 1 FROM r s WHERE s.grp = r.grp AND NOT s.weak AND r.weak AND s.base_rank < r.base_rank AND s.new_rank > r.new_rank) AS inverted FROM r),
    a AS (SELECT grp, count(*)::BIGINT AS n, count_if(base_rank <> new_rank)::BIGINT AS moved, max(abs(base_rank - new_rank))::BIGINT AS largest_move, count_if(inverted)::BIGINT AS inversions FROM i GROUP BY 1)
    SELECT *, CASE WHEN moved = 0 THEN 'none' WHEN inversions > 0 THEN 'unsafe' WHEN largest_move > 3 THEN 'borderline' ELSE 'safe' END AS verdict FROM a"""
)
def preference_shift(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    ranks = o.select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "weak").otherwise("strong").alias("state"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).cast("bigint").alias("base_rank"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("bigint").alias("new_rank"),
    )
    return feedback.preference_shift(ranks)


@query(
    """WITH v AS (SELECT l_orderkey AS item, l_returnflag AS decision, CASE WHEN l_linenumber > 5 THEN 'failed' ELSE 'ok' END AS status FROM lineitem)
    SELECT item, count(*)::BIGINT AS votes, count_if(status = 'ok')::BIGINT AS valid, count(DISTINCT CASE WHEN status = 'ok' THEN decision END)::BIGINT AS decisions,
    min(CASE WHEN status = 'ok' THEN decision END) AS first_decision, CASE WHEN count_if(status = 'ok') = 0 THEN 'error' WHEN count_if(status = 'ok') = 1 THEN CASE WHEN count(*) = 1 THEN 'single' ELSE 'insufficient' END
    WHEN count(DISTINCT CASE WHEN status = 'ok' THEN decision END) = 1 THEN 'unanimous' ELSE 'split' END AS consensus FROM v GROUP BY 1"""
)
def judge_consensus(spark, sf_dir):
    v = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("decision"), F.when(F.col("l_linenumber") > 5, "failed").otherwise("ok").alias("status"))
    return feedback.judge_consensus(v)


def backtest(spark, sf_dir):
    """Line items as backtest records: three scores in [0, 1] and an outcome."""
    x = t(spark, sf_dir, "lineitem")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("family"), (F.col("l_quantity") / 50).alias("final"), (F.col("l_extendedprice") / 110000).alias("readiness"),
        (F.col("l_discount") * 10).alias("penalty"), (F.col("l_tax") * 12.5).alias("quality"), (F.col("l_partkey") % 60).cast("double").alias("age_days"), (F.col("l_linestatus") == "O").alias("positive"), F.col("l_suppkey").alias("grp"),
    )


SQL_RECORDS = "r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS family, l_quantity / 50 AS final, l_extendedprice / 110000 AS readiness, l_discount * 10 AS penalty, l_tax * 12.5::DOUBLE AS quality, (l_partkey % 60)::DOUBLE AS age_days, l_linestatus = 'O' AS positive, l_suppkey AS grp FROM lineitem)"
FINALS, READY, PENALTIES = [0.3, 0.45, 0.55, 0.65, 0.75], [0.2, 0.3, 0.4, 0.5], [0.1, 0.25, 0.45, 0.65, 0.85]
SQL_GRID = f"""{SQL_RECORDS}, g AS (SELECT * FROM (SELECT unnest({FINALS}::DOUBLE[]) AS final_min), (SELECT unnest({READY}::DOUBLE[]) AS readiness_min), (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty_max)),
    t AS (SELECT family, count(*)::BIGINT AS n, count_if(positive)::BIGINT AS positives FROM r GROUP BY 1),
    k AS (SELECT family, final_min, readiness_min, penalty_max, count_if(final >= final_min AND readiness >= readiness_min AND penalty <= penalty_max)::BIGINT AS kept,
        count_if(positive AND final >= final_min AND readiness >= readiness_min AND penalty <= penalty_max)::BIGINT AS kept_positive FROM r, g GROUP BY ALL),
    m AS (SELECT family, n, positives, final_min, readiness_min, penalty_max, kept, kept_positive, round(coalesce(kept_positive / nullif(kept, 0), 0) + 1e-9::DOUBLE, 4) AS precision, round(coalesce(kept_positive / nullif(positives, 0), 0) + 1e-9::DOUBLE, 4) AS recall,
        round(coalesce((kept - kept_positive) / nullif(n - positives, 0), 0) + 1e-9::DOUBLE, 4) AS leakage FROM k JOIN t USING (family)),
    o AS (SELECT *, round(0.5::DOUBLE * precision + 0.3::DOUBLE * recall - 0.2::DOUBLE * leakage + 1e-9::DOUBLE, 4) AS objective FROM m)"""


@query(f"WITH {SQL_GRID} SELECT * FROM o")
def threshold_grid(spark, sf_dir):
    return evaluate.threshold_grid(backtest(spark, sf_dir), FINALS, READY, PENALTIES)


@query(f"WITH {SQL_GRID} SELECT family, final_min, readiness_min, penalty_max, objective, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY objective DESC, final_min, readiness_min, penalty_max) AS rank FROM o) WHERE rank <= 8")
def threshold_grid_best(spark, sf_dir):
    best = evaluate.best_scenarios(evaluate.threshold_grid(backtest(spark, sf_dir), FINALS, READY, PENALTIES))
    return best.select("family", "final_min", "readiness_min", "penalty_max", "objective", "rank")


def _sql_close(x: str, pivot: float, spread: float) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, 1 - least(1::DOUBLE, abs({x} - {pivot}::DOUBLE) / {spread}::DOUBLE)))"


def _sql_clip(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


@query(
    f"""WITH {SQL_RECORDS} SELECT id, family, round(0.35::DOUBLE * {_sql_close('final', .5, .5)} + 0.25::DOUBLE * {_sql_close('readiness', .5, .5)} + 0.20::DOUBLE * {_sql_clip('penalty')}
    + 0.10::DOUBLE * {_sql_clip('quality')} + 0.10::DOUBLE * least(1::DOUBLE, age_days / 30) + 1e-9::DOUBLE, 4) AS priority FROM r ORDER BY priority DESC, id LIMIT 100"""
)
def review_priority_topk(spark, sf_dir):
    return evaluate.review_priority(backtest(spark, sf_dir), 100).select("id", "family", "priority")


@query(
    f"""WITH {SQL_RECORDS}, a AS (SELECT id, round({_sql_close('final', .5, .35)} + 1e-9::DOUBLE, 4) AS uncertainty, round(CASE WHEN NOT positive THEN {_sql_clip('readiness')} ELSE 0 END + 1e-9::DOUBLE, 4) AS salvage,
    round(1 / sqrt(count(*) OVER (PARTITION BY grp)) + 1e-9::DOUBLE, 4) AS novelty, round(abs(final - readiness) + 1e-9::DOUBLE, 4) AS disagreement FROM r)
    SELECT *, round(0.4::DOUBLE * uncertainty + 0.25::DOUBLE * salvage + 0.2::DOUBLE * novelty + 0.15::DOUBLE * disagreement + 1e-9::DOUBLE, 4) AS score FROM a"""
)
def active_learning_scores(spark, sf_dir):
    return evaluate.active_learning(backtest(spark, sf_dir)).select("id", "uncertainty", "salvage", "novelty", "disagreement", "score")


# Stateful folds --------------------------------------------------------------------------


@query()
def rate_limiter(spark, sf_dir):
    """Denied events aren't recorded, which no range window can say."""
    e = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return state.rate_limit(e, 3600.0, 3)


@query()
def feedback_states(spark, sf_dir):
    """Status depends on the order of feedback."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return state.feedback_fold(e)


# Reviews, checks and policies ------------------------------------------------------------

WEIGHTS = [("worth", "price", 0.5), ("worth", "quantity", 0.5), ("steady", "discount", 4.0), ("steady", "quantity", 0.3)]


@query(
    "WITH w(fit, signal, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS) + """),
    v AS (SELECT l_partkey AS id, round(avg(l_extendedprice) / 100000, 6) AS price, round(avg(l_discount), 6) AS discount, round(avg(l_quantity) / 50, 6) AS quantity FROM lineitem GROUP BY 1),
    s AS (UNPIVOT v ON price, discount, quantity INTO NAME signal VALUE actual)
    SELECT id, fit, round(least(1.0::DOUBLE, sum(weight * actual)) + 1e-9::DOUBLE, 4) AS score FROM s JOIN w USING (signal) GROUP BY ALL"""
)
def fit_scores(spark, sf_dir):
    return review.fit_scores(_signals(spark, sf_dir), spark.createDataFrame(WEIGHTS, "fit string, signal string, weight double"))


@query(
    """WITH l AS (SELECT user_id, max(ts)::TIMESTAMP AS last FROM events GROUP BY 1), n AS (SELECT max(ts)::TIMESTAMP AS now FROM events)
    SELECT user_id, floor((epoch(now) - epoch(last)) / 86400) < 1 AS cooling FROM l, n"""
)
def cooldown(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).select("user_id", review.on_cooldown(F.col("last"), F.col("now"), 1).alias("cooling"))


@query(
    """SELECT doc_id, len(m)::BIGINT AS n_numbers, array_to_string(list_transform(m, lambda x: x::INT), '-') AS numbers
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]{1,6}') AS m FROM documents)"""
)
def number_sequences(spark, sf_dir):
    n = t(spark, sf_dir, "documents").select("doc_id", review.number_sequence(F.coalesce("text", F.lit(""))).alias("m"))
    return n.select("doc_id", F.size("m").cast("bigint").alias("n_numbers"), F.array_join(F.transform("m", lambda x: x.cast("string")), "-").alias("numbers"))


@query(
    """WITH q AS (SELECT l_orderkey AS id, min(l_returnflag) AS stem, max(l_linestatus) AS answer, list_sort(list(l_linestatus || CASE WHEN l_linenumber > 1 THEN '' || l_linenumber ELSE '' END)) AS options FROM lineitem GROUP BY 1),
    e AS (SELECT id, (coalesce(stem, '') = '')::INT + (coalesce(answer, '') = '')::INT + (len(options) < 2 OR len(options) > 6)::INT + (len(list_distinct(options)) < len(options))::INT + (NOT list_contains(options, answer))::INT AS errors,
        (list_max(list_transform(options, lambda x: length(x))) > 3 * list_min(list_transform(options, lambda x: length(x))))::INT AS warnings FROM q)
    SELECT id, errors::BIGINT AS n_errors, greatest(0, 100 - 25 * errors - 5 * warnings)::BIGINT AS score, errors = 0 AS passed FROM e"""
)
def question_checks(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem")
    option = F.concat("l_linestatus", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).otherwise(""))
    q = x.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("stem"), F.max("l_linestatus").alias("answer"), F.sort_array(F.collect_list(option)).alias("options"))
    return review.checked(q).select("id", F.size("errors").cast("bigint").alias("n_errors"), F.col("score").cast("bigint").alias("score"), "passed")


@query(
    """WITH p AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'O') AS stable FROM orders GROUP BY 1)
    SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'zero_material' WHEN stable = 0 THEN 'gray_only' ELSE 'stable_present' END AS bucket, count(*)::BIGINT AS n FROM customer LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1"""
)
def funnel_buckets(spark, sf_dir):
    m = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.when(F.col("o_orderstatus") == "O", "stable").otherwise("gray").alias("channel"))
    out = review.funnel(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id")), m)
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders)
    SELECT grp, count_if(a <= 3 AND b <= 3)::BIGINT AS stay, count_if(a = b)::BIGINT AS same_place, max(abs(a - b))::BIGINT AS largest_move FROM r WHERE a <= 3 OR b <= 3 GROUP BY 1"""
)
def rank_stability(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey"))
    out = review.rank_stability(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return out.withColumn("largest_move", F.col("largest_move").cast("bigint"))


@query(
    """WITH i AS (SELECT event_type AS type, user_id AS item, count(*) AS rounds, bool_or(value > 90) AS approved, count_if(value > 20) AS ok FROM events GROUP BY ALL)
    SELECT type, count(*)::BIGINT AS items, round(count_if(approved) / count(*), 4) AS approval_rate, round(avg(rounds) + 1e-9::DOUBLE, 4) AS mean_rounds, round(sum(ok) / sum(rounds) + 1e-9::DOUBLE, 4) AS action_success FROM i GROUP BY 1"""
)
def review_metrics(spark, sf_dir):
    a = t(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("item"), (F.col("value") > 90).alias("approved"), (F.col("value") > 20).alias("ok"))
    return review.review_metrics(a)


@query("""SELECT '{"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}' AS signature, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def profile_signatures(spark, sf_dir):
    return review.profile_signatures(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    f"""WITH {SQL_RECORDS}, c AS (SELECT family, list_distinct(quantile_cont(final, [0.25, 0.5, 0.75, 0.9])) AS q FROM r GROUP BY 1), a AS (SELECT family, unnest(q) AS final_min, q FROM c),
    p AS (SELECT * FROM (SELECT family, final_min, unnest(q) AS fallback_min FROM a) WHERE fallback_min <= final_min),
    k AS (SELECT family, final_min, fallback_min, count_if(final >= final_min)::BIGINT AS kept, count_if(final >= final_min AND positive)::BIGINT AS kept_positive,
        count_if(final < final_min AND final >= fallback_min)::BIGINT AS held, count_if(final < final_min AND final >= fallback_min AND positive)::BIGINT AS held_positive FROM r JOIN p USING (family) GROUP BY ALL)
    SELECT family, round(final_min, 6) AS final_min, round(fallback_min, 6) AS fallback_min, kept, kept_positive, held, held_positive,
        round(0.8::DOUBLE * coalesce(kept_positive / nullif(kept, 0), 0) + 0.2::DOUBLE * coalesce(held_positive / nullif(held, 0), 0) + 1e-9::DOUBLE, 4) AS objective FROM k"""
)
def policy_evaluation(spark, sf_dir):
    r = backtest(spark, sf_dir)
    out = review.evaluate_policies(r, review.policy_space(r, [0.25, 0.5, 0.75, 0.9]))
    return out.withColumns({"final_min": F.round("final_min", 6), "fallback_min": F.round("fallback_min", 6)})


@query()
def policy_search(spark, sf_dir):
    """All policies on the four axes of the reference; a test holds them against plain Python."""
    status = F.when(F.col("quality") > 0.8, "deprecated").when(F.col("quality") > 0.5, "gray").otherwise("promoted")
    r = backtest(spark, sf_dir).select("family", "final", "readiness", "penalty", status.alias("status"), F.col("positive").alias("stable"))
    current = {"recommended": 0.5, "review_readiness": 0.6, "review_penalty": 0.28, "fallback_review_score": 0.4}
    return review.search_policies(r, current)


@query(
    f"""WITH {SQL_RECORDS} SELECT family, CASE WHEN final >= 0.6 AND readiness >= 0.5 AND penalty <= 0.4 THEN 'recommended' WHEN final >= 0.45 AND penalty <= 0.7 THEN 'hold' ELSE 'weak' END AS state,
    CASE WHEN (final >= 0.66)::INT + (readiness >= 0.66)::INT + (quality >= 0.66)::INT >= 2 THEN 'hard' WHEN (final <= 0.33)::INT + (readiness <= 0.33)::INT + (quality <= 0.33)::INT >= 2 THEN 'easy' ELSE 'medium' END AS band,
    count(*)::BIGINT AS n FROM r GROUP BY ALL"""
)
def difficulty_band_counts(spark, sf_dir):
    state_of = review.selection_state(F.col("final"), F.col("readiness"), F.col("penalty")).alias("state")
    return backtest(spark, sf_dir).groupBy("family", state_of, review.difficulty_band(F.array("final", "readiness", "quality")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# Genres, tails and summaries -------------------------------------------------------------


# Rules for the languages of the tables; the operator's own are for Chinese.
GENRES: genre.Rules = {
    "policy": (("plan", "notice", "measures"), ("policy", "authority", "licensed"), ("gov",)),
    "law": (("act", "law"), ("shall", "liability", "license"), ("court",)),
    "science": (("why", "how"), ("research", "experiment", "data"), ("src3",)),
    "news": (("report", "news"), ("according", "released", "with"), ("src1",)),
    "practice": (("case", "practice"), ("practice", "example", "for"), ("src2",)),
}


def _sql_genres() -> str:
    def hits(hay: str, words: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"contains({hay}, '{w}')::INT" for w in words) + ")"

    rows = " UNION ALL ".join(
        f"SELECT id, {i} AS rule, '{g}' AS genre, 2.0::DOUBLE * {hits('title', a)} + 1.0::DOUBLE * {hits('body', b)} + 1.5::DOUBLE * {hits('src', c)} AS score FROM a"
        for i, (g, (a, b, c)) in enumerate(GENRES.items())
    )
    return f"""WITH a AS (SELECT doc_id AS id, lower(substr(coalesce(text, ''), 1, 60)) AS title, lower(coalesce(text, '')) AS body, lower(coalesce(source, '')) AS src FROM documents),
        s AS (SELECT * FROM ({rows}) WHERE score > 0), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rule) AS place FROM s QUALIFY place <= 3)
        SELECT a.id, coalesce(b.genre, 'general') AS genre, coalesce(b.score, 0) AS score, coalesce(place, 1)::INT AS rank FROM a LEFT JOIN b USING (id)"""


@query(_sql_genres())
def genre_top3(spark, sf_dir):
    """The documents have no title; their first 60 characters stand in for one."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", "source")
    return genre.genre_top(d, 3, GENRES, "general").select("id", "genre", "score", "rank")


@query(
    f"""WITH {UNITS} SELECT article_id, md5(CASE WHEN len(paras) = 0 THEN '' WHEN length(two) <= 900 THEN two ELSE five END) AS tail_md5
    FROM (SELECT *, array_to_string(paras[greatest(1, len(paras) - 1):], chr(10) || chr(10)) AS two, array_to_string(sents[greatest(1, len(sents) - 4):], '') AS five FROM u)"""
)
def tail_windows(spark, sf_dir):
    cut = segment.units(articles(spark, sf_dir))
    return cut.select("article_id", F.md5(genre.tail_window(F.col("paras"), F.col("sents"))).alias("tail_md5"))


@query(
    f"""WITH {UNITS}, f AS (SELECT article_id, paras, list_position(list_transform(paras, lambda p: regexp_matches(p, '^.{{1,25}}$')), false) AS first FROM u)
    SELECT article_id, (len(paras) - CASE WHEN first IS NULL OR first = 0 THEN len(paras) ELSE first - 1 END)::BIGINT AS n_left FROM f"""
)
def front_matter(spark, sf_dir):
    """Paragraphs left after a leading run of very short ones."""
    cut = segment.units(articles(spark, sf_dir))
    return cut.select("article_id", F.size(genre.without_front(F.col("paras"), "^.{1,25}$")).cast("bigint").alias("n_left"))


@query(
    rf"""WITH w AS (SELECT lang, unnest({WORDS.format("coalesce(text, '')")}) AS word FROM documents), c AS (SELECT lang, word, count(*)::BIGINT AS n FROM w GROUP BY ALL)
    SELECT lang, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 5"""
)
def top_words(spark, sf_dir):
    return genre.top_words(t(spark, sf_dir, "documents"), "lang", 5).select("lang", "word", "n")


@query(
    f"""WITH {SQL_RECORDS}, x AS (SELECT *, CASE WHEN grp % 2 = 0 THEN 'even' ELSE 'odd' END AS task FROM r)
    SELECT coalesce(family, '*') AS family, coalesce(task, '*') AS task, count(*)::BIGINT AS n, count_if(positive)::BIGINT AS positives, round(avg(final) + 1e-9::DOUBLE, 4) AS mean_final,
    round(avg(readiness) + 1e-9::DOUBLE, 4) AS mean_readiness, round(avg(penalty) + 1e-9::DOUBLE, 4) AS mean_penalty, round(quantile_cont(final, 0.75) + 1e-9::DOUBLE, 4) AS p75_final,
    round(max(quality) + 1e-9::DOUBLE, 4) AS best_quality FROM x GROUP BY GROUPING SETS ((family), (task), ())"""
)
def backtest_summary(spark, sf_dir):
    r = backtest(spark, sf_dir).withColumn("task", F.when(F.col("grp") % 2 == 0, "even").otherwise("odd"))
    out = genre.group_summary(r, ["family", "task"])
    return out.withColumns({"family": F.coalesce("family", F.lit("*")), "task": F.coalesce("task", F.lit("*"))})


@query("SELECT json_extract_string(props, '$.k') AS card_id, count(*)::BIGINT AS n, round(avg(value) + 1e-9::DOUBLE, 4) AS mean_value FROM events GROUP BY 1")
def json_path_counts(spark, sf_dir):
    """Counts by a path of a JSON column, which is parsed once."""
    e = t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("card_id"), "value")
    return e.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), T.rounded(F.avg("value"), 4).alias("mean_value"))

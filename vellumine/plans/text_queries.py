"""Queries of refined segments and of promotion to targets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import questions
from ..functions import text as T
from ..operators import dedupe, pool, promotion, refine, slots
from .catalogue import articles, query, t


@query()
def refined_segments(spark, sf_dir):
    """Segments of every document after refinement; a test holds them against plain Python."""
    out = refine.refined(refine.segments(articles(spark, sf_dir)))
    return out.select("article_id", "place", "kind", "n_segments", "first_paragraph", "last_paragraph", "first", "last", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


TYPES = ("main_idea", "sentence_order", "sentence_fill", "continuation")
#: Size of the pool, coverage of a type, cap of an article, least quality.
TARGET, PER_TYPE, CAP, LEAST = 420, 150, 3, 0.30
#: Characters from which on a confirmed document is stable.
STABLE_CHARS = 12_000


def _pool(spark, sf_dir: str):
    """Documents as materials: confirmed long ones are stable, others that aren't rejected are gray; four neighbours are an article."""
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    n = F.coalesce("n_chars", F.lit(0))
    types = F.array_compact(
        F.array(F.when(n >= 1500, "main_idea"), F.when(n % 3 == 0, "sentence_order"), F.when(n % 4 == 1, "sentence_fill"), F.when(F.col("lang").isin("fr", "de"), "continuation"))
    )
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("article_id"), "source", types.alias("types"), F.least(F.lit(1.0), n / 4000.0).alias("quality"),
        F.contains(F.coalesce("text", F.lit("")), F.lit("!!")).cast("int").alias("n_flags"), ((F.col("label") == 1) & (n >= STABLE_CHARS)).alias("stable"), "label",
    )
    stable = F.coalesce("stable", F.lit(False))
    return rows.where(~stable & (F.coalesce("label", F.lit(1)) == 1)).drop("label", "stable"), rows.where(stable).drop("label", "stable")


_ROWS = f"""m AS (SELECT d.doc_id AS id, coalesce(d.n_chars, 0) AS n, d.doc_id // 4 AS article_id, d.source, least(1::DOUBLE, coalesce(d.n_chars, 0) / 4000) AS quality, contains(coalesce(d.text, ''), '!!')::INT AS n_flags, l.quality AS label,
        list_filter([CASE WHEN d.n_chars >= 1500 THEN 'main_idea' END, CASE WHEN d.n_chars % 3 = 0 THEN 'sentence_order' END, CASE WHEN d.n_chars % 4 = 1 THEN 'sentence_fill' END,
                     CASE WHEN d.lang IN ('fr', 'de') THEN 'continuation' END], lambda x: x IS NOT NULL) AS types
        FROM documents d LEFT JOIN labels l USING (doc_id)),
    s AS (SELECT * FROM m WHERE label = 1 AND n >= {STABLE_CHARS}), g AS (SELECT * FROM m WHERE coalesce(label, 1) = 1 AND NOT coalesce(label = 1 AND n >= {STABLE_CHARS}, false) AND len(types) > 0)"""


@query(
    f"""WITH {_ROWS},
    ty AS (SELECT type, greatest(0, {PER_TYPE} - (SELECT count(*) FROM s WHERE list_contains(s.types, type))) AS missing FROM (SELECT unnest({list(TYPES)}) AS type)),
    sc AS (SELECT g.*, (SELECT count(*) FROM s WHERE s.article_id = g.article_id) AS na, (SELECT count(*) FROM s WHERE s.source = g.source) AS nso, (SELECT sum(missing) FROM ty WHERE list_contains(g.types, type)) AS lacking FROM g),
    k AS (SELECT *, round(quality * 2 + lacking / {PER_TYPE} + CASE WHEN list_contains(types, 'sentence_order') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN list_contains(types, 'sentence_fill') THEN 0.3::DOUBLE ELSE 0 END
        + CASE WHEN list_contains(types, 'continuation') THEN 0.4::DOUBLE ELSE 0 END - 0.05::DOUBLE * n_flags - 0.1::DOUBLE * na - 0.01::DOUBLE * nso + 1e-9::DOUBLE, 6) AS score FROM sc WHERE quality >= {LEAST} OR lacking > 0),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, id) <= {CAP} - na)),
    w AS (SELECT *, {TARGET} - (SELECT count(*) FROM s) - place AS short, {', '.join(f"(SELECT missing FROM ty WHERE type = '{x}') - count_if(list_contains(types, '{x}')) OVER (ORDER BY place) AS short_{x}" for x in TYPES)} FROM p),
    -- a candidate is promoted if before it something was still missing
    b AS (SELECT *, lag(greatest(short, {', '.join(f'short_{x}' for x in TYPES)})) OVER (ORDER BY place) AS before FROM w)
    SELECT id, article_id, array_to_string(types, ',') AS types, score FROM b
    WHERE coalesce(before, greatest({TARGET} - (SELECT count(*) FROM s), (SELECT max(missing) FROM ty))) > 0"""
)
def promoted_materials(spark, sf_dir):
    """The gray materials that fill the pool up to its targets."""
    gray, stable = _pool(spark, sf_dir)
    return promotion.promoted(gray, stable, TYPES, TARGET, PER_TYPE, CAP, LEAST).withColumn("types", F.array_join("types", ","))


_LINES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_AT = "list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{}'))"
_TRIM = r"nullif(regexp_replace({}, '^\s+|\s+$', '', 'g'), '')"


def _option(letter: str) -> str:
    last = f"list_max(list_filter(range(1, len(o) + 1), lambda k: starts_with(l[o[k]], '{letter}')))"
    end = f"coalesce(o[{last} + 1], CASE WHEN m > o[{last}] THEN m END, len(l) + 1)"
    own = f"list_concat([regexp_replace(l[o[{last}]], '{questions.OPTION}', '')], l[o[{last}] + 1:{end} - 1])"
    return f"CASE WHEN {last} IS NULL THEN '' ELSE coalesce({_TRIM.format(f'''array_to_string(list_filter({own}, lambda x: x <> '' AND NOT regexp_matches(x, '{questions.ANALYSIS}')), chr(10))''')}, '') END"


@query(
    f"""WITH a AS (SELECT doc_id, {_LINES} AS l, regexp_extract(coalesce(text, ''), '{questions.ANSWER}', 0) AS said, nullif(regexp_extract(coalesce(text, ''), '{questions.ANSWER}', 1), '') AS answer FROM documents),
    b AS (SELECT *, {_AT.format('^[A-D]')} AS o, ({_AT.format(questions.ANALYSIS)})[1] AS m, ({_AT.format(questions.STEM)})[1] AS s FROM a),
    c AS (SELECT *, coalesce(s, o[1], 1) - 1 AS n_head, least(coalesce(m, o[len(o)] + 1), (list_filter(range(1, len(l) + 1), lambda i: said <> '' AND contains(l[i], said)))[1]) AS begins FROM b),
    d AS (SELECT doc_id, {_TRIM.format(f"array_to_string(list_transform(l[1:n_head], lambda x, i: CASE WHEN i = 1 THEN regexp_replace(regexp_replace(x, '{questions.SECTION}', ''), '^{chr(92)}s+|{chr(92)}s+$', '', 'g') ELSE x END), chr(10))")} AS passage, l[s] AS stem,
        {', '.join(f'{_option(x)} AS option_{x.lower()}' for x in questions.LETTERS)}, answer, CASE WHEN begins <= len(l) THEN {_TRIM.format('array_to_string(l[begins:], chr(10))')} END AS analysis FROM c)
    SELECT doc_id, md5(passage) AS passage, md5(stem) AS stem, {', '.join(f'md5(option_{x.lower()}) AS option_{x.lower()}' for x in questions.LETTERS)}, answer, md5(analysis) AS analysis,
        stem IS NOT NULL AND passage IS NOT NULL AND {' AND '.join(f"option_{x.lower()} <> ''" for x in questions.LETTERS)} AS complete FROM d"""
)
def parsed_questions(spark, sf_dir):
    """Every document read as a question; texts are shown as digests."""
    out = questions.parsed(t(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = ["passage", "stem", *(f"option_{x.lower()}" for x in questions.LETTERS), "analysis"]
    return out.select("doc_id", "answer", "complete", *(F.md5(x).alias(x) for x in shown))


@query()
def reselected_items(spark, sf_dir):
    """Labelled documents by language, filled up from those without a label where too few are selected; a test holds it against plain Python."""
    items = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        F.concat_ws("-", "lang", F.col("source")).alias("query"), F.col("doc_id").alias("candidate_id"), F.floor(F.col("doc_id") / 4).alias("article_id"), "source", F.coalesce("n_chars", F.lit(0)).cast("double").alias("score"), "text", "quality"
    )
    base, more = items.where("quality = 1").drop("quality"), items.where("quality IS NULL").drop("quality")
    return pool.reselected(base, more, "query", 6, 4).select("query", "candidate_id", "place")


@query()
def slot_units(spark, sf_dir):
    """The slots of every document that are worth a blank; a test holds them against plain Python."""
    return slots.units(articles(spark, sf_dir)).withColumn("text", F.md5("text"))


@query()
def slot_gates(spark, sf_dir):
    """Every sentence of the documents that may be a slot, with trace, role and reasons; a test holds them against plain Python."""
    shown = ("article_id", "position", "paragraph", "sentence", *slots.NUMBERS, "role", "role_reason", "resolved", "resolved_reason", "function", "value_reason", "ready")
    # a table may come in one piece; without a number of partitions Spark sizes them itself
    return slots.gates(articles(spark, sf_dir).repartition("article_id")).select(*shown)


_TOKENS = """list_filter(list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}'), list_transform(range(1, length(regexp_replace({0}, '[^一-鿿]+', '', 'g'))),
    lambda i: substring(regexp_replace({0}, '[^一-鿿]+', '', 'g'), i, 2)))), lambda w: w NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOP_PAIRS) + "))"


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS x FROM documents), b AS (SELECT *, string_split(x, chr(10))[-1] AS last FROM a),
    c AS (SELECT doc_id, {_TOKENS.format("substring(x, 1, length(x) - length(last))")} AS e, {_TOKENS.format("last")} AS c FROM b), d AS (SELECT *, len(list_intersect(e, c)) AS n FROM c)
    SELECT doc_id, n::INT AS n_shared, len(c)::INT AS n_candidate, CASE WHEN len(c) > 0 THEN round(n / len(c) + 1e-9::DOUBLE, 4) ELSE 0::DOUBLE END AS ratio FROM d"""
)
def closing_support(spark, sf_dir):
    """How much of what a document's last line speaks of has been spoken of before."""
    docs = t(spark, sf_dir, "documents").select("doc_id", T.strip(F.coalesce("text", F.lit(""))).alias("x")).withColumn("last", F.substring_index("x", "\n", -1))
    docs = docs.select("doc_id", T.tokens(F.substring("x", F.lit(1), F.length("x") - F.length("last"))).alias("e"), T.tokens(F.col("last")).alias("c"))
    return docs.select("doc_id", T.support(F.col("e"), F.col("c")).alias("s")).select("doc_id", "s.*")


#: Characters that fingerprints begin with alike, to be neighbours.
HEAD = 16
#: Fingerprints of a head that are sorted together, about; of heads with more, each is compared with the next one of its part.
BLOCK = 20_000


@query()
def similar_neighbours(spark, sf_dir):
    """Different fingerprints of documents, each with the next one that begins alike, compared from both sides; a test holds the comparison against difflib."""
    prints = t(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.coalesce("text", F.lit(""))).alias("a"))
    prints = prints.groupBy("a").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    prints = prints.withColumn("head", F.substring("a", 1, HEAD))
    # only heads of more than a block are split, so that no window holds much more than that
    large = prints.groupBy("head").count().where(F.col("count") > BLOCK).select("head", F.ceil(F.col("count") / BLOCK).alias("parts"))
    prints = prints.join(large, "head", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    follows = Window.partitionBy("head", "part").orderBy("a")
    pairs = prints.withColumns({"b": F.lead("a").over(follows), "next_id": F.lead("doc_id").over(follows)}).where("next_id IS NOT NULL")
    there = dedupe.sequence_similarity(pairs)
    back = dedupe.sequence_similarity(there.select("doc_id", "next_id", "n_copies", F.col("alike").alias("forth"), F.col("b").alias("a"), F.col("a").alias("b")))
    return back.select("doc_id", "next_id", "n_copies", "forth", F.col("alike").alias("back"))

"""Pool scans, gates, statistics, upserts, deduplication and retrieval."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .walk import walked

#: Terms of one search, at most.
MAX_TERMS = 12


def newest_first(articles: DataFrame, limit: int = 200) -> DataFrame:
    """The newest articles; ties by identifier."""
    return articles.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def term_search(articles: DataFrame, terms: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Articles with any of up to twelve terms in any of the columns, in any letter case; more are refused."""
    if len(terms) > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms, not {len(terms)}")
    test = F.lit(False)
    for term in terms:
        for column in columns:
            test = test | F.lower(F.col(column)).contains(term.lower())
    return articles.where(test)


def review_gate(materials: DataFrame, reviews: DataFrame, strict: bool) -> DataFrame:
    """Materials with review_status and servable.

    strict: only confirmed or automatically tagged ones serve; else all but rejected ones.
    """
    joined = materials.join(reviews, "id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("missing_review")))
    if strict:
        servable = F.col("review_status").isin("auto_tagged", "review_confirmed")
    else:
        servable = F.col("review_status") != "review_rejected"
    return joined.withColumn("servable", servable)


def requirement_score(op: Column, actual: Column, value: Column) -> Column:
    """1 if a requirement is met, else partial credit; a missing signal counts as 0."""
    actual = F.coalesce(actual, F.lit(0.0))
    credit = F.when(value == 0, 0.0).otherwise(T.clip(actual / value))
    return (
        F.when(op == ">=", F.when(actual >= value, 1.0).otherwise(credit))
        .when(op == ">", F.when(actual > value, 1.0).otherwise(credit))
        .when(op == "<=", F.when(actual <= value, 1.0).otherwise(F.when(actual == 0, 0.0).otherwise(T.clip(value / actual))))
        .when(op == "<", F.when(actual < value, 1.0).otherwise(F.when(actual == 0, 0.0).otherwise(T.clip(value / actual))))
        .when(op == "target", T.clip(1 - F.abs(actual - value)))
        .otherwise(F.when(actual == value, 1.0).otherwise(0.0))
    )


def card_scores(signals: DataFrame, requirements: DataFrame) -> DataFrame:
    """Mean requirement score of each (id, card): ``signals`` is long (id, signal, actual)."""
    joined = signals.join(F.broadcast(requirements), "signal")
    return joined.groupBy("id", "card").agg(F.avg(requirement_score(F.col("op"), F.col("actual"), F.col("value"))).alias("score"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; order must end in an identifier."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_k_distinct(rows: DataFrame, by: list[str], text: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """Per-type limits after dropping repeated texts; a duplicate takes no place."""
    first = rows.withColumn("dup", F.row_number().over(W.partitionBy(*by, text).orderBy(*order))).where("dup = 1").drop("dup")
    limit = F.lit(0)
    for kind, most in limits.items():
        limit = F.when(F.col(by[0]) == kind, most).otherwise(limit)
    # the largest limit bounds what a window keeps of a group
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= max(limits.values(), default=0))
    return ranked.where(F.col("rank") <= limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win; created_at of an old row is kept."""
    columns = [c for c in old.columns if c not in (key, "created_at")]
    n = new.select(F.col(key), F.lit(True).alias("is_new"), *(F.col(c).alias(f"new_{c}") for c in [*columns, "created_at"]))
    joined = old.join(n, key, "full_outer")
    return joined.select(
        key,
        *(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns),
        F.coalesce("created_at", "new_created_at").alias("created_at"),
    )


def ingest_dedupe(articles: DataFrame) -> DataFrame:
    """One article per content hash (the first), then the latest per URL."""
    hashed = articles.withColumn("hash", T.content_hash(F.col("text")))
    first = hashed.withColumn("r", F.row_number().over(W.partitionBy("hash").orderBy("id"))).where("r = 1").drop("r")
    return first.withColumn("r", F.row_number().over(W.partitionBy("url").orderBy(F.desc("id")))).where("r = 1").drop("r")


def asset_upsert(assets: DataFrame) -> DataFrame:
    """One asset of each content hash: the latest by (updated_at, id), with the earliest created_at."""
    hashed = assets.withColumn("hash", T.content_hash(F.col("text")))
    latest = F.max(F.struct("updated_at", "id")).alias("x")
    return hashed.groupBy("hash").agg(latest, F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("n")).select("hash", "x.id", "x.updated_at", "created_at", "n")


def diverse_queue(candidates: DataFrame, top_k: int, family_cap: int, card_cap: int, window: int = 512) -> DataFrame:
    """The first ``top_k`` of candidates (score, id, article_id, family, card) by score, then id, under caps; filled up without caps.

    A family and a card may appear so often; an article that is in already is passed over once its family has half of
    its places; a missing family or card has no cap.  See ``walk.walked`` for how candidates are gone through.
    """
    half = max(1, family_cap // 2)

    def admits(counts: list[Counter], row: dict, phase: int) -> bool:
        return phase == 1 or not (counts[0][row["article_id"]] and counts[1][row["family"]] >= half)

    slim = candidates.select(F.lit(0).alias("__x_all"), F.col("id").alias("candidate_id"), F.col("score").cast("double").alias("score"), "article_id", "family", "card")
    quotas = [(None, family_cap, card_cap), (None, None, None)]
    places = walked(slim, "__x_all", ["article_id", "family", "card"], quotas, top_k, window, admits)
    # at most top_k rows
    return candidates.join(F.broadcast(places.select(F.col("candidate_id").alias("id"), F.col("place").cast("int").alias("place"))), "id")


def demote(materials: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Old primaries of an article that has new materials lose their place; others keep it."""
    fresh = new_ids.select("id", F.lit(True).alias("is_new"))
    marked = materials.join(fresh, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    renewed = marked.groupBy("article_id").agg(F.bool_or("is_new").alias("renewed"))
    out = marked.join(renewed, "article_id")
    return out.withColumn("is_primary", F.col("is_primary") & (F.col("is_new") | ~F.col("renewed"))).drop("renewed", "is_new")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows and the number of all rows; only offset + limit rows are ordered."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def fingerprint(text: Column) -> Column:
    """The first 500 letters and digits (ASCII, or Chinese characters)."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+", ""), 1, 500)


def diverse(items: DataFrame, key: str, limit: int, window: int = 64) -> DataFrame:
    """Greedy selection per query under quotas of article, source and card.

    Items (key, candidate_id, article_id, source, score; card and text if there are any) are
    taken by score, ties by identifier, in three phases of widening quotas and one without any;
    a missing article, source or card has no quota, and a text near to a selected one (or
    without letters and digits) is passed over.  All items take part; see ``walk.walked``.
    """
    # Quotas of article, source and card by phase.
    quotas = [(1, max(1, limit // 3), max(1, limit // 4)), (2, max(2, limit // 2), max(2, limit // 3)), (3, limit, limit), (None, None, None)]
    groups = ["article_id", "source", *(["card"] if "card" in items.columns else [])]
    with_text = "text" in items.columns
    slim = items.select(key, "candidate_id", *groups, F.col("score").cast("double").alias("score"), *([fingerprint(F.col("text")).alias("print")] if with_text else []))
    slim = slim.where(F.col("candidate_id").isNotNull() & (F.col("candidate_id").cast("string") != ""))
    if with_text:
        slim = slim.where("print <> ''")
    places = walked(slim, key, groups, [q[: len(groups)] for q in quotas], limit, window).withColumnsRenamed({key: "__x_key", "candidate_id": "__x_id"})
    chosen = items.join(places, F.col(key).eqNullSafe(F.col("__x_key")) & (F.col("candidate_id") == F.col("__x_id"))).drop("__x_key", "__x_id")
    # an identifier that is repeated holds one place
    return top_k(chosen, [key, "candidate_id"], [F.desc_nulls_last("score")], 1).drop("rank")


def reselected(base: DataFrame, more: DataFrame, key: str, limit: int, least: int) -> DataFrame:
    """The selection of ``base``; queries for which it has fewer than ``least`` items select anew from both.

    Items are as in ``diverse``; those of ``more`` whose identifier is in ``base`` are left out.
    """
    first = diverse(base, key, limit)
    keys = base.select(key).unionByName(more.select(key)).distinct().withColumnRenamed(key, "__x_of")
    same = F.col(key).eqNullSafe(F.col("__x_of"))
    counted = first.select(F.col(key).alias("__x_of")).groupBy("__x_of").agg(F.count(F.lit(1)).alias("__x_n")).withColumnRenamed("__x_of", "__x_key")
    keys = keys.join(counted, F.col("__x_of").eqNullSafe(F.col("__x_key")), "left")
    short = keys.where(F.coalesce("__x_n", F.lit(0)) < least).select("__x_of")
    fresh = more.join(base.select(F.col(key).alias("__x_of"), F.col("candidate_id").alias("__x_id")), same & (F.col("candidate_id") == F.col("__x_id")), "left_anti")
    both = base.unionByName(fresh).join(short, same, "left_semi")
    return first.join(short, same, "left_anti").unionByName(diverse(both, key, limit))


# Patterns of the addresses of articles, and words of index pages and of titles that are none.
DATED = r"/\d{4}[-/]\d{2}[-/]\d{2}/|\d{8}"
CONTENT = r"/content[_/]|/c\.html?$|/c\d+-\d+\.html"
DETAIL = r"/news/\d+\.html$|/detail/\d{8}/|/t\d+_\d+\.htm[l]?$"
DETAIL_LOW = r"/newsdetail(?:_forward)?_\d+$"
NUMBERED = r"/\d{8}/\d+[_-]\d+(_\d+)?\.html?$"
ARTICLE_WORDS = ("article", "content", "detail", "news", "forward")
INDEX_WORDS = ("index", "node_", "home.htm", "category", "recommend", "agreement", "privacy", "useragreement", "list", "channel", "column", "topic", "login", "register", "undefined")
OTHER_TITLES = ("privacy", "agreement", "user agreement", "terms", "login", "register")
# Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "ref")


def url_score(url: Column, title: Column, patterns: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> Column:
    """Additive bonuses and penalties of a link; a link is kept if it has more than 0.

    patterns: of the addresses of a site's articles; keywords: of the titles that are wanted.
    """
    low, t = F.lower(url), F.coalesce(title, F.lit(""))

    def w(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    def any_of(x: Column, words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | x.contains(word)
        return out

    own = F.lit(0)
    if patterns:
        own = F.when(url.rlike("|".join(f"(?:{p})" for p in patterns)), 12).otherwise(-8)
    return (
        own
        + w(url.rlike(DATED), 6)
        + w(url.rlike(CONTENT), 5)
        + w(url.rlike(DETAIL) | low.rlike(DETAIL_LOW), 5)
        + F.when(F.length(t) >= 12, 3).when(F.length(t) >= 8, 2).otherwise(0)
        + w(any_of(t, keywords), 5)
        + w(any_of(low, ARTICLE_WORDS), 2)
        + w(low.rlike(NUMBERED), 3)
        - w(any_of(low, INDEX_WORDS), 10)
        - w(any_of(F.lower(t), OTHER_TITLES), 10)
        - w(url.rlike(r"^https?://[^/]+/?$"), 12)
    )


def allowed_domain(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or lies below one; ports don't count."""
    name = F.substring_index(F.lower(F.trim(host)), ":", 1)
    out = F.lit(False)
    for d in (x.strip().lower() for x in domains if x.strip()):
        out = out | (name == d) | name.endswith(f".{d}")
    return (name != "") & out


def url_normal(url: Column) -> Column:
    """Without fragment, path parameters and the parameters that only track, and with a path; values aren't encoded anew."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, r"^(https?://[^/?]+)(\?|$)", "$1/$2")
    bare = F.regexp_replace(bare, r";[^/?]*(\?|$)", "$1")
    cut = F.regexp_replace(bare, rf"(?i)([?&])(?:{'|'.join(TRACKING)})=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, "&{2,}", "&"), r"\?&", "?"), "[?&]$", "")


#: Endings of addresses that are no pages.
NO_PAGES = (".css", ".js", ".json", ".xml", ".txt", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".ttf")
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>.*?</a>"
HREF = r"(?is)^<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*)</a>$"
EMBEDDED = r"[\"']((?:https?://|/)[^\"'<>\s]{6,})[\"']"


def discovered(pages: DataFrame, domains: tuple[str, ...] | None = None, patterns: tuple[str, ...] = (), keywords: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """(page_id, link, score, place): the best links of (page_id, url, html), each address once.

    Anchors with any kind of quotes and addresses embedded anywhere; resolved against the page's own, filtered by
    domain (that of the page, if none are given), normalised and scored.
    """
    html = F.coalesce("html", F.lit(""))
    anchors = F.transform(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(
            F.trim(F.regexp_replace(a, HREF, "$1$2$3")).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(a, HREF, "$4"), "<[^>]*>", " "), r"\s+", " ")).alias("title")
        ),
    )
    embedded = F.transform(F.regexp_extract_all(html, F.lit(EMBEDDED), F.lit(1)), lambda u: F.struct(F.rtrim(F.replace(u, F.lit("\\/"), F.lit("/")), F.lit(",;")).alias("href"), F.lit("").alias("title")))
    rows = pages.select("page_id", "url", F.explode(F.concat(anchors, embedded)).alias("x")).select("page_id", "url", "x.*")
    rows = rows.where(~F.lower("href").rlike("^(?:javascript|mailto|tel):") & ~F.lower(F.regexp_replace("href", "[?#].*$", "")).rlike(rf"(?:{'|'.join(map(_quoted, NO_PAGES))})$"))
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", "^(https?://[^?#]*/)", 1)
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), "href"))
    full = full.when(F.col("href").startswith("/"), F.concat(root, "href")).when(F.col("href") != "", F.concat(F.when(folder.rlike("^https?://$") | (folder == ""), F.concat(root, F.lit("/"))).otherwise(folder), "href"))
    rows = rows.withColumn("link", url_normal(full)).where(F.col("link").rlike("^https?://"))
    host = F.regexp_extract("link", "^https?://([^/?#]+)", 1)
    rows = rows.where(allowed_domain(host, domains) if domains is not None else host == F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    # of equal addresses the longest title counts
    best = rows.groupBy("page_id", "link").agg(F.max(F.struct(F.length("title").alias("n"), "title")).alias("t"))
    scored = best.select("page_id", "link", url_score(F.col("link"), F.col("t.title"), patterns, keywords).alias("score")).where("score > 0")
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "link"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def _quoted(ending: str) -> str:
    return ending.replace(".", r"\.")

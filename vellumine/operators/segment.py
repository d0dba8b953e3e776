"""Windows over paragraphs and sentences, and the throttle for short articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Spans that a short article keeps, by kind.
SHORT_LIMITS = {"paragraph": 4, "paragraph_window": 2, "sentence_group": 1, "story_fragment": 1}


def units(articles: DataFrame) -> DataFrame:
    """article_id, lang, paras, sents of (article_id, lang, text)."""
    body = T.clean(F.coalesce("text", F.lit("")))
    return articles.select(
        "article_id", "lang", T.paragraphs(body, F.col("lang")).alias("paras"), T.sentences(body, F.col("lang")).alias("sents"), F.length(body).alias("n_chars")
    )


def _windows(cut: DataFrame, items: str, sizes: range, glue: str, kind: str) -> DataFrame:
    """Full windows of each size at each start."""
    n = F.size(items)
    spans = F.flatten(F.array(*(_starts(n, size) for size in sizes)))
    return cut.select("article_id", "n_chars", F.size("sents").alias("n_sents"), items, F.explode(spans).alias("w")).select(
        "article_id",
        "n_chars",
        "n_sents",
        F.lit(kind).alias("kind"),
        (F.col("w.first") - 1).alias("start"),
        F.col("w.size").alias("size"),
        F.array_join(F.slice(items, F.col("w.first"), F.col("w.size")), glue).alias("text"),
    )


def _starts(n, size: int):
    return F.transform(
        F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("first"), F.lit(size).alias("size")),
    )


def paragraph_windows(articles: DataFrame) -> DataFrame:
    """Single paragraphs and windows of two and three."""
    cut = units(articles)
    return _windows(cut, "paras", range(1, 2), "\n\n", "paragraph").unionByName(_windows(cut, "paras", range(2, 4), "\n\n", "paragraph_window"))


def sentence_windows(articles: DataFrame) -> DataFrame:
    """Windows of three to six sentences; they cross paragraphs."""
    return _windows(units(articles), "sents", range(3, 7), "", "sentence_group")


def story_fragments(articles: DataFrame) -> DataFrame:
    """The first three paragraphs of articles that have as many."""
    return _windows(units(articles), "paras", range(3, 4), "\n\n", "story_fragment").where("start = 0")


def throttled(articles: DataFrame) -> DataFrame:
    """All spans; of articles with up to 8 sentences or 1,200 characters only the first of each kind.

    An article's spans of a kind stand in its row by size and start, so the first are a slice of them: nothing is shuffled.
    """
    cut = units(articles).withColumn("n_sents", F.size("sents"))
    short = (F.col("n_sents") <= 8) | (F.col("n_chars") <= 1200)

    def spans(items: str, sizes: range, glue: str, kind: str, most: int | None = None):
        n = F.size(items)
        each = F.transform(
            F.flatten(F.array(*(_starts(n, size) for size in sizes))),
            lambda w: F.struct(
                F.lit(kind).alias("kind"), (w["first"] - 1).alias("start"), w["size"].alias("size"), F.array_join(F.slice(items, w["first"], w["size"]), glue).alias("text")
            ),
        )
        return each if most is None else F.slice(each, 1, most)

    kinds = {
        "paragraph": ("paras", range(1, 2), "\n\n", None), "paragraph_window": ("paras", range(2, 4), "\n\n", None), "sentence_group": ("sents", range(3, 7), "", None),
        "story_fragment": ("paras", range(3, 4), "\n\n", 1),
    }
    parts = []
    for kind, (items, sizes, glue, most) in kinds.items():
        every = spans(items, sizes, glue, kind, most)
        fits = F.col("n_sents") >= 6 if kind == "story_fragment" else F.lit(True)
        parts.append(F.when(~short, every).when(fits, F.slice(every, 1, SHORT_LIMITS[kind])).otherwise(F.slice(every, 1, 0)))
    return cut.select("article_id", "n_chars", "n_sents", F.explode(F.concat(*parts)).alias("x")).select("article_id", "n_chars", "n_sents", "x.*")


def numbered_sentences(articles: DataFrame) -> DataFrame:
    """Sentences with a running number per article."""
    return units(articles).select("article_id", F.posexplode("sents").alias("sentence_index", "sentence"))


def paragraph_bounds(articles: DataFrame) -> DataFrame:
    """(article_id, paragraph, first, last): the running numbers of each paragraph's first and last sentence."""
    body = T.clean(F.coalesce("text", F.lit("")))
    lang = F.col("lang")
    cut = articles.select("article_id", F.transform(T.paragraphs(body, lang), lambda p: F.size(T.sentences(p, lang))).alias("sizes"))
    cut = cut.withColumn("before", T.sums_before(F.col("sizes")))
    bounds = F.zip_with("sizes", "before", lambda n, at: F.struct(at.alias("first"), (at + n - 1).alias("last")))
    return cut.select("article_id", F.posexplode(bounds).alias("paragraph", "b")).select("article_id", "paragraph", "b.first", "b.last").where("last >= first")


#: Candidate kinds over paragraphs: sizes of windows, least and most characters.
PARAGRAPH_CANDIDATES = {"closed_span": ((1, 2), 90, None), "multi_paragraph_unit": ((2, 3), 140, 1200)}
#: Most paragraphs and characters of a whole passage, and sentences of an insertion context.
WHOLE_PARAGRAPHS, WHOLE_CHARS, CONTEXT = 8, 1600, 3


def rule_candidates(articles: DataFrame) -> DataFrame:
    """(article_id, kind, start, size, text) of candidates by rule, each text once in its kind: the first of equals stays.

    Whole passages that are short enough, windows of paragraphs within their bounds (those at the end may be shorter), and windows of
    three sentences (two at the end of an article).  All spans of an article are built, and equal ones told, in its row; nothing is shuffled.
    """
    cut = units(articles)
    p, s = F.size("paras"), F.size("sents")

    def windows(items: str, n, size: int, least: int, kind: str, glue: str):
        starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        spans = F.transform(
            starts,
            lambda i: F.struct(
                F.lit(kind).alias("kind"), (i - 1).alias("start"), F.least(F.lit(size), n - i + 1).alias("size"), F.array_join(F.slice(items, i, F.lit(size)), glue).alias("text")
            ),
        )
        return F.filter(spans, lambda x: x["size"] >= least)

    whole = F.array(F.struct(F.lit("whole_passage").alias("kind"), F.lit(0).alias("start"), p.alias("size"), F.array_join("paras", "\n\n").alias("text")))
    parts = [F.when((p > 0) & (p <= WHOLE_PARAGRAPHS) & (F.col("n_chars") <= WHOLE_CHARS), whole).otherwise(F.filter(whole, lambda x: F.lit(False)))]
    for kind, (sizes, least, most) in PARAGRAPH_CANDIDATES.items():
        for size in sizes:
            spans = windows("paras", p, size, min(sizes) if kind == "multi_paragraph_unit" else 1, kind, "\n\n")
            parts.append(_within(spans, least, most))
    parts.append(windows("sents", s, CONTEXT, 2, "insertion_context_unit", ""))
    # equal texts of a kind stand side by side when sorted, the first of them in front
    hashed = F.transform(F.concat(*parts), lambda x: F.struct(x["kind"].alias("kind"), F.sha2(x["text"], 256).alias("sha"), x["start"].alias("start"), x["size"].alias("size"), x["text"].alias("text")))
    cut = cut.select("article_id", F.array_sort(hashed).alias("__x_all"))
    new = F.filter("__x_all", lambda x, i: (i == 0) | (x["kind"] != F.get("__x_all", i - 1)["kind"]) | (x["sha"] != F.get("__x_all", i - 1)["sha"]))
    return cut.select("article_id", F.explode(new).alias("x")).select("article_id", "x.kind", "x.start", "x.size", "x.text")


def _within(spans, least: int, most: int | None):
    return F.filter(spans, lambda x: (F.length(x["text"]) >= least) & (F.length(x["text"]) <= (most if most is not None else 2**31 - 1)))


def adapted(cut: DataFrame, target: int, tolerance: int) -> DataFrame:
    """``cut`` (sents, first, last: places from 0 of a candidate's sentences) with first, last grown to a length.

    A candidate that is too short takes in its shorter neighbour, the left one of equals, until it is long enough or all sentences are in.
    """
    least = max(80, target - max(0, tolerance))
    n = F.size("sents")
    state = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("n"))
    own = F.length(F.array_join(F.slice("sents", F.col("first") + 1, F.col("last") - F.col("first") + 1), ""))
    sizes = F.col("__x_sizes")

    def grow(acc, _):
        left, right = F.get(sizes, acc["a"] - 1), F.get(sizes, acc["b"] + 1)
        to_left = left.isNotNull() & (right.isNull() | (left <= right))
        return (
            F.when((acc["n"] >= least) | (left.isNull() & right.isNull()), acc)
            .when(to_left, state(acc["a"] - 1, acc["b"], acc["n"] + left))
            .otherwise(state(acc["a"], acc["b"] + 1, acc["n"] + right))
        )

    grown = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), state(F.col("first"), F.col("last"), own), grow)
    out = cut.withColumn("__x_sizes", F.transform("sents", lambda x: F.length(x))).withColumn("__x_w", grown)
    return out.withColumns({"first": F.col("__x_w.a"), "last": F.col("__x_w.b")}).drop("__x_sizes", "__x_w")

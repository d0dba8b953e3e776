"""Genres by keyword rules, and leading and trailing parts of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

Rules = dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]]
#: Weights of keyword hits in title, text and source.
WEIGHTS = (2.0, 1.0, 1.5)
# The default genre; by genre the keywords of titles, texts and sources; the order breaks ties.
DEFAULT = "通用说明文"
RULES: Rules = {
    "政策文": (("意见", "方案", "办法", "通知", "规定", "决定", "若干措施", "规划"), ("贯彻落实", "政策措施", "制度安排", "有关部门", "实施意见", "工作机制"), ("国务院", "政府", "人民网", "新华网")),
    "法条文": (("条例", "法", "司法解释", "法律责任", "实施细则"), ("依照", "本条", "应当", "不得", "法律责任", "条款"), ("最高人民法院", "最高人民检察院", "中国人大网")),
    "科普文": (("为什么", "如何", "揭秘", "原理", "知识", "科普"), ("科学家", "实验", "研究发现", "原理", "机制", "数据表明"), ("科普中国", "中国科协", "新华社")),
    "评论文": (("评论", "时评", "人民论坛", "观点", "锐评"), ("值得警惕", "启示", "折射出", "说明了", "提醒我们", "应当看到"), ("人民网", "光明网")),
    "新闻报道": (("消息", "报道", "观察", "现场", "纪实"), ("记者", "获悉", "报道称", "据了解", "发布会", "消息人士"), ("新华社", "人民网", "光明网", "央视网")),
    "通知公告": (("公告", "通报", "公示", "名单", "提示"), ("特此公告", "现将", "公示如下", "通报如下", "请按要求"), ("政府", "教育部", "财政部")),
    "经验材料": (("做法", "经验", "案例", "启示录", "样本"), ("实践中", "探索出", "典型做法", "经验表明", "案例显示"), ("人民网", "半月谈", "中国组织人事报")),
}


def _hits(hay: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for word in words:
        out = out + hay.contains(word).cast("int")
    return out


def genre_scores(articles: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(id, genre, rule, score) for genres that score, of (id, title, text, source)."""
    title, text, source = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "text", "source"))
    rows = [
        F.struct(
            F.lit(i).alias("rule"),
            F.lit(g).alias("genre"),
            (WEIGHTS[0] * _hits(title, a) + WEIGHTS[1] * _hits(text, b) + WEIGHTS[2] * _hits(source, c)).alias("score"),
        )
        for i, (g, (a, b, c)) in enumerate(rules.items())
    ]
    return articles.select("id", F.explode(F.filter(F.array(*rows), lambda r: r["score"] > 0)).alias("r")).select("id", "r.*")


def best_genre(title: Column, text: Column, source: Column, rules: Rules = RULES, default: str = DEFAULT) -> Column:
    """The best genre of an article, in its row: no shuffle."""
    title, text, source = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, text, source))
    rows = [
        F.struct((-(WEIGHTS[0] * _hits(title, a) + WEIGHTS[1] * _hits(text, b) + WEIGHTS[2] * _hits(source, c))).alias("by"), F.lit(i).alias("rule"), F.lit(g).alias("genre"))
        for i, (g, (a, b, c)) in enumerate(rules.items())
    ]
    best = F.array_min(F.array(*rows))
    return F.when(best["by"] < 0, best["genre"]).otherwise(F.lit(default))


def genre_top(articles: DataFrame, k: int = 3, rules: Rules = RULES, default: str = DEFAULT) -> DataFrame:
    """The k best genres of each article; those without a hit get the default."""
    ranked = genre_scores(articles, rules).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), F.asc("rule"))))
    best = ranked.where(F.col("rank") <= k).select("id", "genre", "score", "rank")
    return articles.select("id").join(best, "id", "left").select(
        "id", F.coalesce("genre", F.lit(default)).alias("genre"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(1)).alias("rank")
    )


def without_front(paragraphs: Column, pattern: str) -> Column:
    """Paragraphs after the leading run that matches a pattern."""
    first = F.aggregate(
        paragraphs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, p: F.struct((a["n"] + (a["on"] & p.rlike(pattern)).cast("int")).alias("n"), (a["on"] & p.rlike(pattern)).alias("on")),
        lambda a: a["n"],
    )
    return F.slice(paragraphs, first + 1, F.greatest(F.lit(0), F.size(paragraphs)))


def tail_window(paragraphs: Column, sentences: Column, limit: int = 900) -> Column:
    """The last two paragraphs if they are short enough, else the last five sentences."""
    two = F.array_join(F.slice(paragraphs, -F.least(F.lit(2), F.greatest(F.lit(1), F.size(paragraphs))), F.lit(2)), "\n\n")
    five = F.array_join(F.slice(sentences, -F.least(F.lit(5), F.greatest(F.lit(1), F.size(sentences))), F.lit(5)), "")
    return F.when(F.size(paragraphs) == 0, "").when(F.length(two) <= limit, two).otherwise(five)


def top_words(texts: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent words of each group; ties by word."""
    counts = texts.select(by, F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), F.asc("word")))).where(F.col("rank") <= k)


def group_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Backtest measures of each grouping in ``by`` and of all, in one pass."""
    c = F.col
    return records.groupingSets([(c(x),) for x in by] + [()], *(c(x) for x in by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("positive").alias("positives"),
        T.rounded(F.avg("final"), 4).alias("mean_final"),
        T.rounded(F.avg("readiness"), 4).alias("mean_readiness"),
        T.rounded(F.avg("penalty"), 4).alias("mean_penalty"),
        T.rounded(F.percentile("final", F.lit(0.75)), 4).alias("p75_final"),
        T.rounded(F.max("quality"), 4).alias("best_quality"),
    )

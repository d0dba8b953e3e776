"""Segments of an article refined: fragments join their neighbours.

What a segment asks for can be seen from itself: one without an end goes with the next, one that leans
on what is before it with the previous, a too fine group of sentences with both.  What becomes of
it depends on what was made before: a segment may have been taken by the one before it, and a
merge must not become too long.  So the requests are columns, and the walk over them, left to right with
the length of what was made last, sees only lengths; it yields runs of segments, from whose
texts the refined ones are joined.  An article is one row; the walk is linear in its segments.

Edge cases: an article without segments gives none; the first segment has nothing before it and the last
nothing after it, so they stay by themselves then; repeated articles are refined each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

#: Characters below which a segment is short and a group of sentences too fine; most characters of a merge.
SHORT, FINE, MOST = 90, 140, 1200
#: Sentences of a group, and of a paragraph from which on it is cut into groups.
GROUP, LONG_PARAGRAPH = 3, 7
# What a segment leans with.
LEANING = ("因此", "同时", "然而", "不过", "对此", "另外")
GLUE = "\n\n"
SEGMENT = "array<struct<kind: string, paragraph: int, first: int, last: int, text: string>>"


def segments(articles: DataFrame) -> DataFrame:
    """(article_id, lang, segments): paragraphs, and long ones in groups of sentences, in order.

    first and last are running numbers of sentences in groups, null in paragraphs.
    """
    body, lang = T.clean(F.coalesce("text", F.lit(""))), F.col("lang")
    cut = articles.select("article_id", "lang", F.transform(T.paragraphs(body, lang), lambda p: F.struct(p.alias("text"), T.sentences(p, lang).alias("sents"))).alias("paras"))

    def of(p: Column, i: Column) -> Column:
        n = F.size(p["sents"])
        whole = F.array(F.struct(F.lit("single_paragraph").alias("kind"), i.alias("paragraph"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), p["text"].alias("text")))
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(GROUP))
        groups = F.transform(
            starts,
            lambda s: F.struct(
                F.lit("sentence_group").alias("kind"), i.alias("paragraph"), s.alias("first"), (F.least(s + GROUP, n) - 1).alias("last"), F.array_join(F.slice(p["sents"], s + 1, F.lit(GROUP)), "").alias("text")
            ),
        )
        return F.when(n >= LONG_PARAGRAPH, groups).otherwise(whole)

    return cut.select("article_id", "lang", F.flatten(F.transform("paras", of)).cast(SEGMENT).alias("segments"))


def requests(segments: Column, lang: Column) -> Column:
    """What each segment asks for: next, prev, both or keep, with the reason."""

    def leans(x: Column) -> Column:
        out = F.lit(False)
        for w in LEANING:
            out = out | x.startswith(w)
        words = F.concat(F.lit(" "), F.array_join(F.slice(T.words(x), 1, 4), " "), F.lit(" "))
        return F.when(lang.isin(*L.UNSPACED), out).otherwise(L.starts_with(words, lang, "soft_start"))

    def one(s: Column) -> Column:
        text, size = s["text"], F.length(s["text"])
        ended = F.when(lang.isin(*L.UNSPACED), text.rlike("[。！？!?]$")).otherwise(text.rlike("[。！？!?.]$"))
        cases = [
            (~ended, "next", "missing_terminal_punctuation"),
            (leans(text) & (size < SHORT), "prev", "bridge_like_fragment"),
            ((s["kind"] == "sentence_group") & (size < FINE), "both", "overly_fine_sentence_group"),
            ((s["kind"] == "single_paragraph") & (size < SHORT), "next", "short_single_paragraph"),
        ]
        out = F.struct(F.lit("keep").alias("ask"), F.lit("heuristic_keep").alias("reason"), size.alias("size"))
        for where, ask, why in reversed(cases):
            out = F.when(where, F.struct(F.lit(ask).alias("ask"), F.lit(why).alias("reason"), size.alias("size"))).otherwise(out)
        return out

    return F.transform(segments, one)


def walk(asks: list[str], sizes: list[int], most: int = MOST) -> list[tuple[int, int, bool]]:
    """Runs of segments (first, last) and whether what the run's last request was changes its kind."""
    runs: list[tuple[int, int, bool]] = []
    made, n, i = 0, len(asks), 0  # made: length of the last run
    while i < n:
        ask = asks[i]
        if ask in ("prev", "both") and runs:
            runs[-1] = (runs[-1][0], i, True)
            made += len(GLUE) + sizes[i]
            if ask == "both" and i + 1 < n and made + sizes[i + 1] <= most:
                i += 1
                runs[-1] = (runs[-1][0], i, True)
                made += len(GLUE) + sizes[i]
        elif ask == "next" and i + 1 < n and sizes[i] + sizes[i + 1] <= most:
            runs.append((i, i + 1, True))
            made = sizes[i] + len(GLUE) + sizes[i + 1]
            i += 1
        else:
            runs.append((i, i, ask != "keep"))
            made = sizes[i]
        i += 1
    return runs


def _walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("merged", pa.bool_())]))
    for batch in batches:
        runs = [[dict(zip(("first", "last", "merged"), r, strict=True)) for r in walk([x["ask"] for x in row or ()], [x["size"] for x in row or ()])] for row in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(runs, kind)], names=["article_id", "lang", "segments", "runs"])


def refined(cut: DataFrame) -> DataFrame:
    """(article_id, place, kind, n_segments, first_paragraph, last_paragraph, first, last, text) of ``segments``."""
    asked = cut.select("article_id", "lang", "segments", requests(F.col("segments"), F.col("lang")).alias("asks"))
    id_type = cut.schema["article_id"].dataType.simpleString()
    walked = asked.mapInArrow(_walk_rows, f"article_id {id_type}, lang string, segments {SEGMENT}, runs array<struct<first: int, last: int, merged: boolean>>")

    def made(r: Column) -> Column:
        own = F.slice("segments", r["first"] + 1, r["last"] - r["first"] + 1)
        head = F.get("segments", r["first"])
        return F.struct(
            F.when(r["merged"], "paragraph_window").otherwise(head["kind"]).alias("kind"), (r["last"] - r["first"] + 1).alias("n_segments"), head["paragraph"].alias("first_paragraph"),
            F.array_max(F.transform(own, lambda s: s["paragraph"])).alias("last_paragraph"), F.array_min(F.transform(own, lambda s: s["first"])).alias("first"), F.array_max(F.transform(own, lambda s: s["last"])).alias("last"),
            F.array_join(F.transform(own, lambda s: s["text"]), GLUE).alias("text"),
        )

    rows = walked.select("article_id", F.posexplode(F.transform("runs", made)).alias("place", "x")).select("article_id", "place", "x.*")
    return rows

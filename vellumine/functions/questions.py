"""Questions in plain text as their parts: passage, stem, options, answer, analysis.

A text is a list of its lines; what a line is can be told from the line alone, and parts are the lines
between such places.  All by columns, linear in the lines.

Edge cases: a null or blank text has no parts; parts that aren't found are null, options empty; of
options with one letter the last counts; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# What answers, analyses, options and numbers of sections look like, and words of stems.
ANSWER = r"(?:故?正确答案(?:为|是)?|答案)[:：]?\s*([A-D])"
ANALYSIS = r"^(?:解析[:：]?|[A-D]项|(?:故?正确答案(?:为|是)?|答案)[:：]?)"
OPTION = r"^[A-D][.．、:：\s]*"
SECTION = r"^[一二三四五六七八九十0-9]+[、.．]?\s*"
HINTS = ("最恰当的一项", "最恰当的一句", "意在强调", "意在说明", "符合文意", "重新排列", "语序正确", "填入横线")
LETTERS = "ABCD"
STEM = rf"（.*）|）.*（|\(.*\)|\).*\(|{'|'.join(HINTS)}"


def _joined(lines: Column) -> Column:
    out = T.strip(F.array_join(lines, "\n"))
    return F.when(out != "", out)


def parsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with passage, stem, option_a to option_d, answer, analysis and complete (nothing but the answer and its analysis is missing)."""
    c = F.col
    whole = T.strip(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"\r\n?", "\n"))
    rows = rows.withColumn("__x_lines", F.filter(F.transform(F.split(whole, "\n"), T.strip), lambda x: x != ""))
    places = lambda pattern: F.filter(F.transform("__x_lines", lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    rows = rows.withColumns(
        {
            "__x_n": F.size("__x_lines"), "__x_options": places("^[A-D]"), "__x_mark": F.get(places(ANALYSIS), 0), "__x_stem": F.get(places(STEM), 0), "__x_said": F.regexp_extract(whole, ANSWER, 0),
            "answer": F.nullif(F.regexp_extract(whole, ANSWER, 1), F.lit("")),
        }
    )
    first = F.coalesce("__x_stem", F.get("__x_options", 0), F.lit(0))
    head = F.transform(F.slice("__x_lines", 1, first), lambda x, i: F.when(i == 0, T.strip(F.regexp_replace(x, SECTION, ""))).otherwise(x))

    def option(letter: str) -> Column:
        last = F.array_max(F.filter(F.transform("__x_options", lambda i, k: F.when(F.get("__x_lines", i).startswith(letter), k)), lambda k: k.isNotNull()))
        start = F.get("__x_options", last)
        end = F.coalesce(F.get("__x_options", last + 1), F.when(c("__x_mark") > start, c("__x_mark")), c("__x_n"))
        own = F.transform(F.slice("__x_lines", start + 1, end - start), lambda x, i: F.when(i == 0, F.regexp_replace(x, OPTION, "")).otherwise(x))
        return F.coalesce(F.when(last.isNotNull(), _joined(F.filter(own, lambda x: (x != "") & ~x.rlike(ANALYSIS)))), F.lit(""))

    told = F.array_min(F.filter(F.transform("__x_lines", lambda x, i: F.when((c("__x_said") != "") & x.contains(c("__x_said")), i)), lambda i: i.isNotNull()))
    begins = F.least(F.coalesce("__x_mark", F.element_at("__x_options", F.when(F.size("__x_options") > 0, -1)) + 1), told)
    analysis = F.when(begins.isNotNull() & (begins < c("__x_n")), _joined(F.slice("__x_lines", begins + 1, c("__x_n"))))
    options = {f"option_{x.lower()}": option(x) for x in LETTERS}
    rows = rows.withColumns({"passage": _joined(head), "stem": F.get("__x_lines", c("__x_stem")), **options, "analysis": analysis})
    complete = c("stem").isNotNull() & c("passage").isNotNull()
    for name in options:
        complete = complete & (c(name) != "")
    return rows.withColumn("complete", complete).drop("__x_lines", "__x_n", "__x_options", "__x_mark", "__x_stem", "__x_said")

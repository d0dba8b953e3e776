"""Readable text: flags as columns, cleaning and repair of misread runs, and objects salvaged from text around them.

Text in UTF-8 that was read by the Chinese table turns into other Chinese characters, two for three
bytes.  Such a run can be told by what it is: written back by that table it is valid UTF-8, which by
chance almost no run of proper text is.  So each run of characters beyond ASCII is written back and
read again; the new reading is taken if all of its bytes make sense but for the last character (whose
end is lost where the number of bytes was odd) and if it has words in it at all.  Nothing is weighed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Mapping
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Traces of text that was read by the wrong table.
SUSPICIOUS = ("浣犳", "鏄", "鐨", "鍙", "鍥", "闂", "璇", "锛", "銆", "鎴", "娌", "瀛", "绗", "瑙", "鎬", "鍑", "璁")
#: So many traces make a text suspect.
MANY_TRACES = 2
#: Least characters of a run that may be read again.
RUN = 3
#: What each flag is given for.
FLAGS = {
    "word_xml_leak": r"<w:|</w:[^>]",
    "escaped_nbsp": r"(?i)\\u00a0|\\xa0|\x{A0}",
    "control_characters": r"[\p{Cc}&&[^\t\n\r\x{80}-\x{9F}]]",
}
#: Taken away: control characters that lay nothing out, and the mark of byte order.
DROPPED = dict.fromkeys([c for c in range(128) if unicodedata.category(chr(c)) == "Cc" and chr(c) not in "\t\n\r\v\f"] + [0xFEFF, *(ord(c) for c in "\v\f")])
BEYOND = re.compile(rf"[^\x00-\x7f]{{{RUN},}}")
#: One after another: what is replaced by what.
SWEEPS = tuple(
    (re.compile(pattern), by)
    for pattern, by in (
        (r"(?i)\\(?:xa0|u00a0)", " "),
        (r"\r\n|\r", "\n"),
        (r"[^\S\n]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n\n\n+", "\n\n"),
    )
)
MARKUP = re.compile(r"<(?=/?[A-Za-z])[^<>]*>")


def _read_again(run: re.Match[str]) -> str:
    """A run of characters as what its bytes mean in UTF-8, or as it is."""
    try:
        data = run[0].encode("gb18030")
    except UnicodeEncodeError:
        return run[0]
    for lost in range(3):
        try:
            new = data[: len(data) - lost].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return new if any(c.isalpha() for c in new) else run[0]
    return run[0]


def repaired(text: str) -> str:
    """The text with its misread runs read again."""
    return BEYOND.sub(_read_again, text)


def readable_text(text: str | None, strip_xml: bool = False) -> str:
    """Decoded references, no markup of word processors (or none at all), repaired, in NFKC, white space squashed; null is empty."""
    text = unescape(text or "")
    if strip_xml or re.search(FLAGS["word_xml_leak"], text):
        text = MARKUP.sub(" ", text)
    text = unicodedata.normalize("NFKC", repaired(text).translate(DROPPED))
    for pattern, by in SWEEPS:
        text = pattern.sub(by, text)
    return text.strip()


@F.pandas_udf(StringType())
def readable(texts: pd.Series) -> pd.Series:
    """``readable_text`` of a column."""
    return texts.map(readable_text)


def salvaged_object(text: str | None) -> str | None:
    """The first JSON object that can be read from some brace on, whatever stands around it, with sorted keys; null if there is none."""
    text, at = text or "", -1
    read = json.JSONDecoder().raw_decode
    while (at := text.find("{", at + 1)) >= 0:
        try:
            found, _ = read(text, at)
        except (ValueError, RecursionError):
            continue
        return json.dumps(found, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(StringType())
def salvaged(texts: pd.Series) -> pd.Series:
    """``salvaged_object`` of a column."""
    return texts.map(salvaged_object)


def issues(text: Column, flags: Mapping[str, str] = FLAGS, traced: Column | None = None) -> Column:
    """The readability flags of a text, in order; none for one that is null, empty or made of spaces of any kind.

    ``traced``: where traces of the wrong table are looked for; everywhere, if it isn't given.
    """
    text = F.coalesce(text, F.lit(""))
    many = F.regexp_count(text, F.lit("|".join(SUSPICIOUS))) >= MANY_TRACES
    given = [F.when(text.rlike(pattern), name) for name, pattern in flags.items()]
    return F.filter(F.array(*given, F.when(many if traced is None else traced & many, "mojibake_text")), lambda flag: flag.isNotNull() & text.rlike(r"[^\p{Zs}]"))

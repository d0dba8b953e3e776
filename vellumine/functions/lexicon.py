"""Language packs as data: for each language the markers of each group.

Markers of languages that put spaces between words are matched as whole words; Chinese
markers are matched anywhere.  A pack can be replaced by any table of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages whose markers are matched anywhere in the text.
UNSPACED = ("zh",)

# The Chinese markers; the other packs are our own.
PACKS: dict[str, dict[str, tuple[str, ...]]] = {
    "zh": {
        "summary": ("总之", "可见", "由此可见", "因此"),
        "turn": ("但是", "然而", "不过"),
        "example": ("例如", "比如", "譬如"),
        "problem": ("问题", "困境", "症结"),
        "method": ("路径", "做法", "措施", "办法", "建议"),
        "enumeration": ("首先", "其次", "再次", "最后"),
        "value": ("应当", "必须", "值得", "关键", "重要"),
        "open_ending": ("未来", "接下来", "仍需", "更要"),
        "context_start": ("对此", "与此同时", "另一方面", "此外", "这也"),
        "soft_start": ("然而", "但是", "同时", "因此", "所以"),
        "cause": ("因此", "所以", "因为", "导致"),
        "carry": ("同时", "并且", "一方面", "另一方面"),
        "opening": ("当前", "面对", "近年来"),
        "restate": ("即", "也就是", "就是说", "例如", "比如"),
        "unique": ("必须", "关键在于", "根本在于"),
        "phenomenon": ("现象", "表现", "反映", "折射"),
        "sequence": ("首先", "其次", "再次", "最后", "总之", "一是", "二是", "三是"),
        "parallel": ("同时", "另一方面", "并且", "此外", "不仅", "而且"),
        "tail": ("这也意味着", "这要求", "这提醒我们", "关键在于", "还需要", "进一步", "从而", "才能"),
        "middle": ("换句话说", "进一步看", "具体而言"),
    },
    "en": {
        "summary": ("therefore", "thus", "overall", "in short", "so"),
        "turn": ("but", "however", "yet", "though"),
        "example": ("for example", "for instance", "such as", "as"),
        "problem": ("problem", "issue", "difficulty"),
        "method": ("method", "measure", "approach", "by"),
        "enumeration": ("first", "second", "next", "finally"),
        "value": ("must", "should", "important", "key", "be"),
        "open_ending": ("future", "next", "still needs", "will"),
        "context_start": ("in this regard", "meanwhile", "on the other hand", "besides", "this"),
        "soft_start": ("however", "but", "therefore", "so", "and"),
        "cause": ("because", "since", "therefore", "for"),
        "carry": ("also", "meanwhile", "with"),
        "opening": ("today", "currently", "in recent years", "in"),
        "restate": ("that is", "namely", "in other words", "that"),
        "unique": ("only", "must", "the key is"),
        "phenomenon": ("phenomenon", "reflects", "shows"),
        "sequence": ("first", "second", "third", "then", "finally", "and"),
        "parallel": ("also", "besides", "not only", "and"),
        "tail": ("this means", "this requires", "further", "thereby", "to"),
        "middle": ("in other words", "specifically", "is"),
    },
    "fr": {
        "summary": ("donc", "ainsi", "en somme"),
        "turn": ("mais", "cependant", "pourtant"),
        "example": ("par exemple", "comme", "tel que"),
        "problem": ("problème", "difficulté"),
        "method": ("méthode", "mesure", "par"),
        "enumeration": ("premièrement", "ensuite", "enfin"),
        "value": ("doit", "important", "est"),
        "open_ending": ("avenir", "désormais"),
        "context_start": ("à cet égard", "en outre", "ce"),
        "soft_start": ("cependant", "mais", "donc", "et"),
        "cause": ("parce que", "car", "pour"),
        "carry": ("aussi", "avec"),
        "opening": ("aujourd hui", "dans"),
        "restate": ("c est à dire", "que", "qui"),
        "unique": ("seul", "il faut"),
        "phenomenon": ("phénomène", "montre"),
        "sequence": ("premièrement", "deuxièmement", "ensuite", "enfin", "et"),
        "parallel": ("aussi", "en outre", "et"),
        "tail": ("cela signifie", "de plus", "sur"),
        "middle": ("autrement dit", "une"),
    },
    "de": {
        "summary": ("also", "daher", "somit"),
        "turn": ("aber", "jedoch", "doch"),
        "example": ("zum beispiel", "etwa", "als"),
        "problem": ("problem", "schwierigkeit"),
        "method": ("methode", "maßnahme", "mit"),
        "enumeration": ("erstens", "zweitens", "schließlich"),
        "value": ("muss", "wichtig", "ist"),
        "open_ending": ("zukunft", "künftig"),
        "context_start": ("dabei", "zudem", "das"),
        "soft_start": ("jedoch", "aber", "daher", "und"),
        "cause": ("weil", "denn", "für"),
        "carry": ("auch", "und"),
        "opening": ("heute", "derzeit", "in"),
        "restate": ("das heißt", "nämlich", "sich"),
        "unique": ("nur", "muss"),
        "phenomenon": ("phänomen", "zeigt"),
        "sequence": ("erstens", "zweitens", "drittens", "dann", "und"),
        "parallel": ("auch", "außerdem", "und"),
        "tail": ("das bedeutet", "ferner", "zu"),
        "middle": ("anders gesagt", "eine"),
    },
    "es": {
        "summary": ("por tanto", "así", "en resumen"),
        "turn": ("pero", "sin embargo", "aunque"),
        "example": ("por ejemplo", "como"),
        "problem": ("problema", "dificultad"),
        "method": ("método", "medida", "con"),
        "enumeration": ("primero", "luego", "finalmente"),
        "value": ("debe", "importante", "es"),
        "open_ending": ("futuro", "próximo"),
        "context_start": ("al respecto", "además", "esto"),
        "soft_start": ("sin embargo", "pero", "y"),
        "cause": ("porque", "pues", "para"),
        "carry": ("también", "con"),
        "opening": ("hoy", "actualmente", "en"),
        "restate": ("es decir", "o sea", "que"),
        "unique": ("solo", "hay que"),
        "phenomenon": ("fenómeno", "refleja"),
        "sequence": ("primero", "segundo", "luego", "y"),
        "parallel": ("también", "además", "y"),
        "tail": ("esto significa", "por"),
        "middle": ("en otras palabras", "una"),
    },
}


def padded(lang: str, marker: str) -> str:
    """A marker as it stands in the searched text."""
    return marker if lang in UNSPACED else f" {marker} "


def by_language(lang: Column, per_language) -> Column:
    """CASE on the language over the columns that ``per_language`` gives for each pack."""
    out = F.lit(None)
    for name in reversed(PACKS):
        out = F.when(lang == name, per_language(name)).otherwise(out)
    return out


def _single(name: str, group: str) -> list[str]:
    """The group's markers that are one word, in a language that spaces its words."""
    return [] if name in UNSPACED else [m for m in PACKS[name][group] if " " not in m]


def found_words(words: Column, lang: Column) -> Column:
    """Which one-word markers of any group a text has; null where markers are matched anywhere.

    ``words``: the text's words.  All groups are tested on this short list, so the text itself
    is gone through once, and again for markers of several words only.
    """

    def held(name: str) -> Column:
        known = dict.fromkeys(m for group in PACKS[name] for m in _single(name, group))
        return F.array_intersect(F.array(*map(F.lit, known)), words) if known else F.lit(None).cast("array<string>")

    return by_language(lang, held)


def any_marker(hay: Column, lang: Column, group: str, found: Column | None = None) -> Column:
    """Whether the searched text has a marker of the group; ``found``: its ``found_words``, if known."""

    def test(name: str) -> Column:
        single = _single(name, group) if found is not None else []
        out = F.arrays_overlap(found, F.array(*map(F.lit, single))) if single else F.lit(False)
        for marker in PACKS[name][group]:
            if marker not in single:
                out = out | hay.contains(padded(name, marker))
        return out

    return F.coalesce(by_language(lang, test), F.lit(False))


def count_present(hay: Column, lang: Column, group: str, found: Column | None = None) -> Column:
    """How many different markers of the group occur."""

    def total(name: str) -> Column:
        single = _single(name, group) if found is not None else []
        out = F.size(F.array_intersect(found, F.array(*map(F.lit, single)))) if single else F.lit(0)
        for marker in PACKS[name][group]:
            if marker not in single:
                out = out + hay.contains(padded(name, marker)).cast("int")
        return out

    return F.coalesce(by_language(lang, total), F.lit(0))


def starts_with(hay: Column, lang: Column, group: str) -> Column:
    def test(name: str) -> Column:
        out = F.lit(False)
        for marker in PACKS[name][group]:
            out = out | hay.startswith(padded(name, marker))
        return out

    return F.coalesce(by_language(lang, test), F.lit(False))


def occurrences(hay: Column, lang: Column, group: str) -> Column:
    """Non-overlapping occurrences of each marker, summed over the group's markers."""

    def total(name: str) -> Column:
        out = F.lit(0)
        for marker in PACKS[name][group]:
            m = padded(name, marker)
            out = out + ((F.length(hay) - F.length(F.replace(hay, F.lit(m), F.lit("")))) / len(m)).cast("int")
        return out

    return F.coalesce(by_language(lang, total), F.lit(0))

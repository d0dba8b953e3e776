"""Marker groups for signals and a scan that finds all markers of a text at once.

The markers of a language, of all groups together, form a trie that is written as one regular
expression.  At each place of a text (each word, where words are spaced) it gives the longest
marker that begins there; shorter ones that begin there too are its beginnings, which is known
beforehand.  So the text is gone through once, and each group is counted on the short list of
what was found: every occurrence counts, those inside longer markers too.

What was found in a text is one string of ``|lang:marker|`` entries, so that one expression per
group serves all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import text as T

# The Chinese markers of each group.  Beside them: the groups of ``lexicon.PACKS``
# and ``MORE`` that serve other languages.
GROUPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "counterintuitive": (("其实", "并非", "恰恰", "反而", "看似", "未必", "不只是", "相反"), ("contrary",)),
    "timeline": (("起初", "后来", "近年", "如今", "至今", "未来", "当年", "随后"), ("timeline", "open_ending")),
    "turning": (("但是", "然而", "不过", "却", "更重要的是", "真正关键在于"), ("turn",)),
    "summary": (("总之", "可见", "因此", "由此", "这意味着", "归根结底"), ("summary",)),
    "question": (("为什么", "何以", "如何", "何处", "谁在", "何以至此"), ("question",)),
    "value": (("应该", "必须", "值得", "重要", "关键", "意义", "警惕"), ("value",)),
    "mechanism": (("机制", "在于", "导致", "作用于", "驱动", "运转"), ("mechanism",)),
    "parallel": (("一方面", "另一方面", "同时", "并且", "此外", "其一", "其二", "首先", "其次"), ("parallel", "enumeration")),
    "context": (("对此", "与此同时", "另一方面", "此外", "这也", "因此", "所以"), ("context_start",)),
    "cause": (("因为", "由于", "缘于", "起因于"), ("cause",)),
    "conclusion": (("所以", "因此", "因而", "故而", "故", "于是", "可见", "看来", "由此"), ("summary",)),
    "closing": (
        ("总之", "可见", "因此", "由此", "这意味着", "归根结底", "所以", "因此", "因而", "故而", "故", "于是", "可见", "看来", "由此"),
        ("summary",),
    ),
    "claiming": (("总之", "可见", "因此", "由此", "这意味着", "归根结底", "但是", "然而", "不过", "却", "更重要的是", "真正关键在于"), ("summary", "turn")),
    "necessary": (("只有", "才", "唯有", "前提", "基础", "保障"), ("unique", "condition")),
    "countermeasure": (
        ("应该", "应当", "应", "需要", "要", "必须", "通过", "采取", "措施", "方式", "方法", "渠道", "途径", "才能"),
        ("method", "measure"),
    ),
    "detail": (("比如", "例如", "例如说", "数据", "案例", "一组"), ("example",)),
    "benefit": (
        ("有助于", "有利于", "促进", "推动", "提升", "带来", "实现", "增强", "改善", "夯实", "激发", "降低", "减少", "拓宽", "便利", "惠及", "共赢"),
        ("benefit",),
    ),
    "benefit_noun": (
        ("效率", "活力", "保障", "安全", "质量", "能力", "收益", "成本", "发展", "共赢", "就业", "便利", "基础", "信心", "满意度", "韧性", "动力"),
        ("gain",),
    ),
    "benefit_degree": (("更加", "更", "有效", "进一步", "从而", "进而"), ("middle", "tail")),
    "action": (
        ("通过", "采取", "推动", "完善", "优化", "健全", "构建", "打造", "提供", "推出", "实施", "建立", "强化", "服务", "机制", "举措", "政策"),
        ("measure",),
    ),
    "support": (("通过", "实施", "完善", "优化", "强化", "服务", "机制", "举措"), ("method",)),
    "weight": (("意义", "作用", "价值", "关键", "重要"), ("value",)),
    "method_tail": (("方法", "路径", "做法", "工具", "机制设计"), ("method",)),
    "theme_raise": (("更重要的是", "归根到底", "进一步看", "背后是", "这意味着", "放到更大背景下看"), ("middle",)),
    "case": (("比如", "例如", "案例", "有人", "一位", "某个"), ("example",)),
    "macro": (("社会", "行业", "整体", "结构性", "更深层", "公共", "群体"), ("macro",)),
    "tension": (("矛盾", "张力", "一方面", "另一方面", "看似", "却", "冲突", "两难"), ("turn", "contrary")),
    "tail_extension": (("这也意味着", "这要求", "这提醒我们", "关键在于", "还需要", "进一步", "接下来", "未来"), ("tail", "open_ending")),
    "next_step": (("接下来", "进一步", "随后"), ("follow",)),
    "forward": (("接下来", "进一步", "还需要", "未来"), ("follow", "open_ending")),
    "trouble": (("问题", "困境", "为何", "谁在", "怎么办"), ("problem", "question")),
    "chain": (("因为", "所以", "因此", "导致", "由此"), ("cause", "summary")),
    "linked": (("因此", "同时", "此外", "不过", "而且", "但"), ("soft_start",)),
    "connector": (("因此", "所以", "同时", "此外", "不过", "而且", "但是", "由此", "总之"), ("carry", "summary", "turn")),
    "call": (("应该", "需要", "必须", "不妨", "应当"), ("unique",)),
    "conclude": (("可见", "由此", "因此", "这说明"), ("soft_start",)),
    "case_tail": (("例如", "比如", "就像", "这一案例"), ("example",)),
    "reference": (("这", "其", "该", "这些", "这种", "这一", "上述", "前者", "后者"), ("reference",)),
    # of units in an order
    "definition": (("就是", "是指", "指的是"), ("definition",)),
    "pronoun": (("这", "那", "其", "该", "此", "这些", "那些", "他们", "它们"), ("reference",)),
    "order_turning": (("虽然", "但是", "可是", "然而", "不过", "却"), ("turn",)),
    "order_parallel": (("同时", "同样", "此外", "也", "另一方面"), ("parallel",)),
    "order_action": (("首先", "其次", "再次", "最后", "第一步", "第二步", "第三步", "先", "再"), ("enumeration",)),
    "order_problem": (("问题在于", "问题是", "难点在于", "困境在于"), ("problem",)),
    "order_solution": (("因此", "所以", "应当", "应该", "必须", "要"), ("summary", "method")),
    "order_question": (("为什么", "如何", "怎么办", "怎样"), ("question",)),
    "order_closing": (
        ("因此", "所以", "可见", "看来", "总之", "由此", "应该", "应当", "应", "需要", "要", "必须", "通过", "采取", "措施", "方式", "方法", "渠道", "途径", "才能"),
        ("summary", "method", "measure"),
    ),
    "order_example": (("例如", "比如", "譬如", "就像"), ("example",)),
    "plain_example": (("例如", "比如", "就像"), ("example",)),
    "viewpoint": (("认为", "指出", "表明", "说明", "可见", "关键在于"), ("restate",)),
    "claim": (("认为", "指出", "表明", "说明", "关键在于"), ("restate",)),
    "beginning": (("首先", "第一步", "起初", "一开始"), ("opening",)),
    "follow": (("随后", "然后", "接着", "最后", "之后", "再", "下一步", "这样", "如此"), ("follow",)),
    "answer": (("因为", "所以", "答案", "关键"), ("cause",)),
    "only": (("只有",), ("unique",)),
    "then_only": (("才",), ("follow",)),
    "if": (("如果",), ("condition",)),
    "then": (("那么", "就", "才", "还要"), ("follow", "summary")),
    "before": (("先",), ("opening",)),
    "after": (("后",), ("follow",)),
    "steps": (("首先", "其次", "再次", "最后", "第一步", "第二步", "第三步", "先", "再", "随后"), ("enumeration", "follow")),
    "timed": (("起初", "后来", "近年", "如今", "至今", "未来", "当年", "随后", "首先", "其次", "再次", "最后", "第一步", "第二步", "第三步", "先", "再"), ("timeline", "open_ending", "enumeration")),
    # of slots to be filled
    "slot_intro": (("当前", "如今", "近年来", "在此背景下", "面对", "随着", "放眼", "当下"), ("opening",)),
    "slot_trouble": (("问题", "挑战", "困境", "矛盾", "痛点", "关键", "核心", "如何", "为何", "亟需", "必须"), ("problem", "question", "value")),
    "slot_ask": (("如何", "为何", "怎么办", "关键在于", "这意味着", "这说明"), ("question",)),
    "slot_raised": (("问题", "挑战", "困境", "矛盾", "痛点", "如何", "为何", "怎么办", "亟需"), ("problem", "question")),
    "slot_modal": (("应当", "应该", "要", "需要", "必须", "建议"), ("unique", "value")),
    "slot_policy": (("会议", "报告", "规划", "意见", "提出", "强调", "部署", "要求", "指出"), ("restate",)),
    "slot_value": (("重要", "关键", "意义", "必须", "亟需", "值得"), ("value",)),
    "slot_pressure": (("问题", "挑战", "困境", "矛盾", "痛点", "风险", "压力"), ("problem",)),
    "slot_summary": (("总之", "可见", "由此可见", "因此"), ("summary",)),
    "slot_tail": (("总之", "可见", "由此", "这启示我们", "这说明"), ("summary",)),
    "slot_remedy": (
        ("应该", "应当", "应", "需要", "要", "必须", "通过", "采取", "措施", "方式", "方法", "渠道", "途径", "才能")
        + ("通过", "采取", "推动", "完善", "优化", "健全", "构建", "打造", "提供", "推出", "实施", "建立", "强化", "服务", "机制", "举措", "政策")
        + ("应该", "必须", "值得", "重要", "关键", "意义", "警惕"),
        ("method", "measure", "value"),
    ),
    "slot_reference": (("这", "这种", "这一", "这一点", "其", "该", "上述", "前述", "由此可见", "这说明"), ("reference",)),
    "slot_weak_carry": (("而这", "这一过程", "这一变化", "由此", "在此基础上", "基于此", "相应地", "由此带来", "这使得", "这使"), ("context_start",)),
    "slot_explaining": (("实际上", "具体来看", "从这个意义上说", "进一步说", "换言之", "也就是说", "这意味着"), ("middle",)),
    "slot_onward": (("因此", "于是", "同时", "接下来", "进一步", "此外", "从而", "关键在于", "更重要的是", "这也意味着"), ("carry", "tail")),
    "slot_new_layer": (("因此", "同时", "此外", "接下来", "更重要的是"), ("soft_start",)),
    "slot_onward_start": (("同时", "因此", "于是", "接下来", "进一步"), ("soft_start", "follow")),
    "slot_bridging": (("正因为如此", "与此同时", "这不仅", "不仅如此", "既", "又", "一方面", "另一方面", "同时也", "既要", "也要"), ("parallel",)),
    "slot_listing": (("包括", "分别", "例如", "比如", "一是", "二是", "三是"), ("example",)),
    "slot_decorative": (("值得关注", "不容忽视", "意义重大", "具有重要意义", "这很重要", "可见其重要性"), ()),
    "slot_firm": (("因此", "由此", "应当", "应该", "需要"), ("summary", "unique")),
}
#: Our own markers of other languages, beside those of ``lexicon.PACKS``.
MORE: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "timeline": ("later", "now", "was"), "question": ("why", "how", "what"), "reference": ("this", "that", "it", "these"), "definition": ("means", "is"), "contrary": ("actually", "not"),
        "follow": ("then", "next", "after", "for"), "condition": ("only", "if"), "benefit": ("helps", "improves", "with"), "gain": ("quality", "safety", "they"), "macro": ("society", "all"),
        "mechanism": ("mechanism", "leads to", "of"), "measure": ("must", "measures", "from"),
    },
    "fr": {
        "timeline": ("plus tard", "maintenant"), "question": ("pourquoi", "comment"), "reference": ("ce", "cela", "il", "elle"), "definition": ("signifie", "est"), "contrary": ("en fait", "pas"),
        "follow": ("puis", "après", "dans"), "condition": ("seulement", "si"), "benefit": ("aide", "améliore", "avec"), "gain": ("qualité", "nous"), "macro": ("société", "tous"),
        "mechanism": ("mécanisme", "du"), "measure": ("mesures", "des"),
    },
    "de": {
        "timeline": ("später", "jetzt"), "question": ("warum", "wie"), "reference": ("das", "dies", "er", "sie"), "definition": ("bedeutet", "ist"), "contrary": ("eigentlich", "nicht"),
        "follow": ("dann", "danach", "in"), "condition": ("nur", "wenn"), "benefit": ("hilft", "verbessert", "auf"), "gain": ("qualität", "sich"), "macro": ("gesellschaft", "von"),
        "mechanism": ("mechanismus", "den"), "measure": ("maßnahmen", "dem"),
    },
    "es": {
        "timeline": ("después", "ahora"), "question": ("por qué", "cómo"), "reference": ("esto", "este", "se", "su"), "definition": ("significa", "es"), "contrary": ("en realidad", "no"),
        "follow": ("luego", "en"), "condition": ("solo", "si"), "benefit": ("ayuda", "mejora", "con"), "gain": ("calidad", "los"), "macro": ("sociedad", "todo"),
        "mechanism": ("mecanismo", "del"), "measure": ("medidas", "las"),
    },
}


def markers(lang: str, group: str) -> tuple[str, ...]:
    """The markers of a group in a language; where one is listed twice, it counts twice."""
    own, packs = GROUPS[group]
    if lang in L.UNSPACED:
        return own
    return tuple(dict.fromkeys(m for p in packs for m in (*L.PACKS[lang].get(p, ()), *MORE[lang].get(p, ()))))


@lru_cache(maxsize=None)
def every_marker(lang: str) -> tuple[str, ...]:
    return tuple(sorted({m for g in GROUPS for m in markers(lang, g)}))


def trie(words: frozenset[str]) -> str:
    """The words as a regular expression that takes the longest first."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    if not heads:
        return ""
    whole = "(?:" + "|".join(re.escape(c) + trie(frozenset(rest)) for c, rest in sorted(heads.items())) + ")"
    return f"{whole}?" if "" in words else whole


def _begins(lang: str, longer: str, marker: str) -> bool:
    """Whether a marker stands wherever a longer one begins."""
    return longer.startswith(marker) if lang in L.UNSPACED else longer == marker or longer.startswith(f"{marker} ")


@lru_cache(maxsize=None)
def _entries(group: str, least: int) -> str:
    """Entries that hold at least so many markers of the group, as a regular expression."""
    parts = []
    for lang in L.PACKS:
        own = Counter(markers(lang, group))
        held = [e for e in every_marker(lang) if sum(n for m, n in own.items() if _begins(lang, e, m)) >= least]
        if held:
            parts.append(f"{lang}:(?:{'|'.join(map(re.escape, held))})")
    return "(?:" + "|".join(parts) + ")" if parts else ""


def count(hits: Column, group: str) -> Column:
    """How often markers of the group occur in what was found."""
    out, least = F.lit(0), 1
    while entries := _entries(group, least):
        out = out + F.regexp_count(hits, F.lit(rf"\|{entries}(?=\|)"))
        least += 1
    return F.when(hits == "", 0).otherwise(out)


def has(hits: Column, group: str) -> Column:
    return (hits != "") & hits.rlike(rf"\|{_entries(group, 1)}\|")


def kinds(hits: Column, group: str) -> Column:
    """How many different markers of the group were found."""
    out = F.lit(0)
    for lang in L.PACKS:
        for m in dict.fromkeys(markers(lang, group)):
            held = [e for e in every_marker(lang) if _begins(lang, e, m)]
            out = out + hits.rlike(rf"\|{lang}:(?:{'|'.join(map(re.escape, held))})\|").cast("int")
    return F.when(~has(hits, group), 0).otherwise(out)


def starts(start: Column, group: str) -> Column:
    """Whether the text begins with a marker of the group; ``start``: what ``scan`` found at its beginning."""
    return (start != "") & start.rlike(f"^{_entries(group, 1)}$")


def _present(hits: Column, lang: str, group: str) -> Column:
    """The different markers of the group that were found, in the group's order."""
    found = []
    for m in markers(lang, group):
        held = [e for e in every_marker(lang) if _begins(lang, e, m)]
        found.append(F.when(hits.rlike(rf"\|{lang}:(?:{'|'.join(map(re.escape, held))})\|"), F.lit(m)))
    return F.array_compact(F.array(*found))


SCANNED = "array<struct<text: string, hits: string, start: string, benefits: array<string>>>"


def scan(texts: Column, lang: Column, results: bool = True) -> Column:
    """For each of the texts: itself, what was found, what stands at its beginning, and its benefits (none without ``results``)."""
    empty = F.array().cast("array<string>")

    def of(name: str) -> Column:
        words, spaced = trie(frozenset(every_marker(name))), name not in L.UNSPACED
        pattern, first = (rf"(?<= )(?=({words}) )", rf"^ ({words})(?= )") if spaced else (f"(?=({words}))", f"^({words})")

        # a step for each thing that is read twice, so that it is worked out once
        def hay(x: Column) -> Column:
            return F.struct(x.alias("text"), (F.concat(F.lit(" "), F.array_join(T.words(x), " "), F.lit(" ")) if spaced else x).alias("hay"))

        def read(x: Column) -> Column:
            found = F.array_join(F.regexp_extract_all(x["hay"], F.lit(pattern), F.lit(1)), f"|{name}:")
            return F.struct(x["text"].alias("text"), found.alias("found"), F.regexp_extract(x["hay"], first, 1).alias("start"))

        def one(x: Column) -> Column:
            return F.struct(
                x["text"].alias("text"),
                F.when(x["found"] == "", "").otherwise(F.concat(F.lit(f"|{name}:"), x["found"], F.lit("|"))).alias("hits"),
                F.when(x["start"] == "", "").otherwise(F.concat(F.lit(f"{name}:"), x["start"])).alias("start"),
            )

        def benefits(x: Column) -> Column:
            """At most two markers that tell of a result."""
            own, nouns = _present(x["hits"], name, "benefit"), _present(x["hits"], name, "benefit_noun")
            taken = F.when(has(x["hits"], "benefit"), F.slice(own, 1, 2)).when(has(x["hits"], "benefit_noun") & has(x["hits"], "benefit_degree"), F.slice(nouns, 1, 2))
            return F.struct(x["text"].alias("text"), x["hits"].alias("hits"), x["start"].alias("start"), (F.coalesce(taken, empty) if results else empty).alias("benefits"))

        return F.transform(F.transform(F.transform(F.transform(texts, hay), read), one), benefits)

    none = F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit("").alias("hits"), F.lit("").alias("start"), empty.alias("benefits")))
    return F.coalesce(L.by_language(lang, of), none)


def strength(n: Column) -> Column:
    return T.marker_strength(n)

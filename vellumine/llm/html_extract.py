"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Scripts, styles and other content that is
never text are skipped; text inside containers for navigation, headers, footers, sidebars,
adverts, notices and reader comments (by tag, role, class or identifier) is boilerplate.  A
class or identifier counts as a whole name: its first or last part must be one of ``MARKED``
and none may be a word like ``no`` or ``has`` (``no-sidebar`` is no sidebar); a main element inside
a container that only its names mark is free of the mark.  Inside an article or main element a
name must be made of such words, and of words for parts of a page, alone (``share-buttons`` is
boilerplate there, ``share-price`` is not), and words that also name what texts deal with
(``side``, ``discussion``) count only beside another.  A form is boilerplate unless a block
in it passes the first pass as good: some pages are wrapped in one form.

The first pass looks at each other block by itself: link density, length and the density of
stop words decide whether it is good, bad or ambiguous.  Inside an article or main element link
density speaks against lists and rows of links only, not against a paragraph that is a link.  The second pass gives an ambiguous
block the label of its nearest decided neighbours, before and after it, inside the same
region of the page (an article or main element, or what is outside them); where both are as
near, good wins inside such an element and bad outside.  Without a decided neighbour a block is
good in an article or main element and on pages that have none.

Character references are decoded, white space inside a block (line breaks included) becomes
one space, blocks are trimmed and joined in page order by one line feed.

Edge cases: a null page counts as empty and gives an empty text; unclosed and misnested tags
are closed by the next block that excludes them; of an unclosed element that is never text only
what stands before the next block is skipped (a script or style goes on to the end); a page without an article or main element
is judged by its blocks alone; nothing is cut, whatever the length; rows are independent; other
columns of the input are ignored; an empty table gives an empty result.  The work grows with the
page, whatever its tags are like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Share of a block's characters inside links above which it is bad.
MAX_LINK_DENSITY = 0.5
#: Blocks of fewer characters are short.
SHORT = 70
#: Blocks of at least so many characters are long.
LONG = 200
#: Share of stop words among a block's words from which running text is assumed.
STOP_DENSITY = 0.12

# Tags by role.
NEVER_TEXT = frozenset("script style noscript template svg math head title iframe object canvas audio video select datalist textarea".split())
BOILERPLATE = frozenset("nav header footer aside form menu button dialog fieldset label".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role attributes that mark boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted nav navbar navigation navi menu "
    "breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies discussion share sharing social related "
    "recommended recommendations pagination pager complementary contentinfo search searchbox form copyright disclaimer legal skip hidden dialog".split()
)
# Words for parts of a page, which say nothing by themselves.
PLACES = frozenset(
    "article post posts articles entry page site content section block area zone panel pane unit slot item items list box bar wrapper wrap container inner outer "
    "top bottom left right inline mobile desktop sticky fixed button buttons link links icon icons tool tools title count js".split()
)
# Words of MARKED that name what texts deal with as often.
TOPICS = frozenset("side discussion legal form search reply replies respond rail skip foot head hidden alert response".split())
# Words that turn the meaning of a name, or tell of the page's layout.
TURNED = frozenset("no not non without with has have is supports layout page body".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an have not you his they which one had were all we there been has "
    "le la les de des du un une et en que qui dans pour par sur au aux est pas ne se ce il elle nous vous avec plus son sa ses ou mais "
    "der die das den dem des ein eine einer und in zu von mit ist auf für im nicht es sich auch als an er sie bei aus nach wie "
    "el los las del y que en un una por con no para su al lo como más pero sus se es o este ya todo esta".split()
)

TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+|[^>]*+)>"
)
#: Inside an article or main element so many links that fill a block are a row of links.
ROW = 3
#: Elements that hold entries.
ENTRIES = frozenset("ul ol li menu dir dl dt dd table tr td th".split())
OPEN_COMMENT = re.compile(r"<!--(?s:.*)\Z")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=\s|/|$))""", re.I)
NAME_PART = re.compile(r"[a-z]+|[^a-z\s_-]+")
BLOCK_START = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?![a-z0-9-])", re.I)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    region: int
    heading: bool
    form: int
    links: int
    listed: bool
    label: str = field(default="")


def _is_marked(attributes: str, inside: bool) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name != "aria-hidden" and any(_is_marked_name(x, inside) for x in value.split()):
            return True
    return False


def _is_marked_name(name: str, inside: bool = False) -> bool:
    """Whether a name marks boilerplate; ``inside``: of an article or main element."""
    parts = [x for x in NAME_PART.findall(name) if x[0].isalpha()]
    if inside:
        marks = [x for x in parts if x in MARKED]
        return any(x not in TOPICS for x in marks) and all(x in MARKED or x in PLACES for x in parts)
    return bool(parts) and (parts[0] in MARKED or parts[-1] in MARKED) and not TURNED.intersection(parts)


def blocks_of(page: str) -> tuple[list[Block], set[int]]:
    """The blocks of a page and the numbers of the regions that are article or main elements."""
    blocks: list[Block] = []
    stack: list[tuple[str, dict[str, int]]] = []  # open elements: tag, and what held before it
    parts: list[tuple[str, bool]] = []
    main: set[int] = set()
    opened: Counter[str] = Counter()  # how many elements of a name are open
    missing: set[str] = set()  # elements that are never text and whose end isn't found any more
    state = {"boilerplate": 0, "named": 0, "region": 0, "form": 0, "links": 0, "heading": False, "inside": 0, "listed": 0}
    held = ("boilerplate", "named", "region", "form", "inside", "listed")
    regions = forms = linked_parts = 0
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked_parts
        whole = SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if whole:
            linked = len(SPACE.sub(" ", html.unescape("".join(p for p, x in parts if x))).strip())
            blocks.append(Block(whole, linked, state["boilerplate"] + state["named"] > 0, state["region"], state["heading"], state["form"], linked_parts, state["listed"] > 0))
        parts.clear()
        linked_parts = 0

    def close(tag: str) -> None:
        """Close the innermost open element of that name and all inside it."""
        if not opened[tag]:
            return
        while stack:
            name, before = stack.pop()
            opened[name] -= 1
            state.update(before)
            if name == tag:
                return

    at = 0
    while True:
        # beyond the last end of a tag only comments may follow, which needn't end
        found = TOKEN.search(page, at) if at <= last_end else OPEN_COMMENT.search(page, at)
        if found is None:
            parts.append((page[at:], state["links"] > 0))
            break
        if found.start() > at:
            parts.append((page[at : found.start()], state["links"] > 0))
        at = found.end()
        tag = (found.groupdict().get("tag") or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag == "a":
                state["links"] = 0
            elif tag in BLOCK:
                flush()
                close(tag)
                if tag[0] == "h" and tag[1:].isdigit():
                    state["heading"] = False
            continue
        if tag in NEVER_TEXT:
            if tag == "head":
                continue  # its children are skipped one by one
            if not found["attrs"].rstrip().endswith("/") or tag in ("script", "style"):
                end = None if tag in missing else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end is None:
                    missing.add(tag)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    following = BLOCK_START.search(page, at)
                    at = following.start() if following else len(page)
            parts.append((" ", False))
        elif tag == "a":
            state["links"] = 1
            linked_parts += 1
        elif tag == "br":
            parts.append((" ", state["links"] > 0))
        elif tag in BLOCK:
            flush()
            state["links"] = 0
            if tag == "hr":
                continue
            if stack and stack[-1][0] == tag and tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):
                close(tag)
            state["heading"] = tag[0] == "h" and tag[1:].isdigit()
            inside = state["inside"] > 0
            stack.append((tag, {k: state[k] for k in held}))
            opened[tag] += 1
            state["inside"] += tag in MAIN
            state["listed"] = (state["listed"] if tag not in MAIN else 0) + (tag in ENTRIES)
            # the header of an article holds its headline; that of a page doesn't
            if tag in BOILERPLATE and tag != "form" and not (tag == "header" and inside):
                state["boilerplate"] += 1
            elif tag == "main":
                state["named"] = 0
            elif tag not in ("article", "body", "html") and _is_marked(found["attrs"], inside):
                state["named"] += 1
            if tag == "form" and not state["form"]:
                forms += 1
                state["form"] = forms
            if tag in MAIN and not state["boilerplate"] + state["named"]:
                regions += 1
                state["region"] = regions
                main.add(regions)
    flush()
    return blocks, main


def classify(blocks: list[Block], main: set[int]) -> None:
    """Label each block ``good`` or ``bad``."""
    wrappers: set[int] = {0}  # forms that hold running text, and no form
    for b in blocks:
        size, words = len(b.text), WORD.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.boilerplate or (b.linked > MAX_LINK_DENSITY * size and (b.region not in main or b.listed or b.links >= ROW)):
            b.label = "bad"
        elif size >= LONG and (stop >= STOP_DENSITY or b.region in main):
            b.label = "good"
            wrappers.add(b.form)
        elif size >= SHORT and stop >= STOP_DENSITY:
            b.label = "good"
        else:
            b.label = ""
    for b in blocks:
        if b.form not in wrappers:
            b.label, b.boilerplate = "bad", True
    before: list[tuple[int, str] | None] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.region))
        if b.label and not b.boilerplate:
            last[b.region] = (i, b.label)
    after: dict[int, tuple[int, str]] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label:
            if not b.boilerplate:
                after[b.region] = (i, b.label)
            continue
        inside = b.region in main
        near = [(abs(i - j), (label == "good") != inside, label) for j, label in filter(None, (before[i], after.get(b.region)))]
        if b.heading and inside:
            b.label = "good"
        elif near:
            b.label = min(near)[2]
        else:
            b.label = "good" if inside or not main else "bad"


def main_text(page: str | None) -> str:
    """The main text of one page."""
    blocks, main = blocks_of(page or "")
    classify(blocks, main)
    return "\n".join(b.text for b in blocks if b.label == "good")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    return pages.select(
        F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")
    ).mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")

"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block of the page. A line weighs its length; lines of menus, headers, footers, sidebars,
adverts and the like, by their element, class or role, weigh nothing, as do lines outside an article that are mostly links, and lines inside
an ``article`` or ``main`` element weigh ``ARTICLE_WEIGHT`` times their length if these elements hold at least ``ARTICLE_SHARE`` of the page's
other text. The weights of ``WINDOW`` lines in a row are summed: a surge is the first line whose sum exceeds ``SURGE``, a dive the next
place where the sum is zero. Stretches between a surge and its dive whose largest sum reaches ``STRETCH_SHARE`` of the page's largest are kept.
If no sum surges, the stretch between weightless lines that weighs most is kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from attnstrata.llm.common import map_batches, pieces, replaced, string_column, with_fields

WINDOW, SURGE = 3, 80
ARTICLE_WEIGHT, ARTICLE_SHARE, STRETCH_SHARE = 40, 1 / 3, 0.3
#: Share of a line's characters in links from which on it counts as empty.
LINK_SHARE = 0.6

BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr html li main ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without article text; their content goes, up to the end tag.
DROPPED = frozenset(
    "aside audio button canvas dialog embed footer form head header iframe map menu nav noscript object select svg "
    "template textarea title video".split()
)
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end a stretch of text; others that weigh nothing stand inside of one.
ENDING = frozenset(["nav", "header", "footer"])
#: Words in a class, id or role that mark an element without article text: the whole name, its last part, or its first before one of ``KINDS``.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary contentinfo cookie cookies disqus dropdown footer header login masthead menu modal navbar nav navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted related search share sharing sidebar signup "
    "social sponsor sponsored subscribe teaser toolbar widget".split()
)
KINDS = frozenset(
    "area banner bar block box button buttons container content form icons inner item items link links list menu module nav section slot "
    "strip unit widget wrap wrapper".split()
)
#: Elements of text themselves: only a whole class name of these counts.
TEXTS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
TEXT_MARKS = frozenset("ad ads advert adverts advertisement comment cookie cookies promo share sharing social sponsored".split())
#: Marks of elements that may hold articles of their own.
REPLIES = frozenset("comment comments commentlist disqus related teaser".split())
CONTAINERS = ("article", "main")
#: Elements without an end tag of their own end at these start tags beside them, and with the element around them.
_CELLS = frozenset("td th tr tbody tfoot thead".split())
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 "
        "h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": _CELLS, "th": _CELLS, "tr": _CELLS - {"td", "th"},
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(?:\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _marks(name: str, attributes: str) -> set[str]:
    """The words of an element's class, id or role that mark it."""
    found = set()
    for kind, a, b, c in _NAMES.findall(attributes):
        for word in (a or b or c).lower().split():
            if name in TEXTS:
                if kind.lower() == "class" and word in TEXT_MARKS:
                    found.add(word)
                continue
            parts = re.split(r"[-_]+", word)
            if parts[-1] in MARKS:
                found.add(parts[-1])
            elif parts[0] in MARKS and parts[-1] in KINDS:
                found.add(parts[0])
    return found


def _unwanted(name: str, attributes: str, depth: int = 0) -> bool:
    """Whether an element weighs nothing; ``depth`` articles are open around it, and an article's own header is text."""
    if name in DROPPED and not (name == "header" and depth):
        return True
    if not attributes or name in ("html", "body"):
        return False
    if name in CONTAINERS:
        return not REPLIES.isdisjoint(_marks(name, attributes))
    return bool(_HIDDEN.search(attributes) or _marks(name, attributes) - ({"header"} if depth else set()))


def _open_ends(name: str, inner: list[str]) -> bool:
    """Whether a start tag that ends ``name`` does so past the elements that are open in it."""
    if name in _CELLS:
        return "table" not in inner
    return not inner if name == "p" else {"address", "div", "p"}.issuperset(inner)


def lines(page: str) -> list[tuple[str, bool]]:
    """Blocks in page order: (text, inside an article or main element); what weighs nothing is an empty line."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    link_held: list[str] = []
    depth, in_link, dropping, level = 0, False, "", 0
    replies = False  # whether the dropped element may hold articles of its own
    inner: list[str] = []  # open elements inside a dropped one whose end tag can be left out

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                linked = " ".join(html.unescape("".join(link_held)).split()) if link_held else ""
                menu = not depth and linked and len(linked) >= LINK_SHARE * len(text)
                out.append(("", False) if menu else (text, depth > 0))
        link_held.clear()

    def gap(lines: int = WINDOW) -> None:
        if not depth:  # a gap inside an article does not end it
            out.extend([("", False)] * lines)

    position, size = 0, len(page)
    while position < size:
        found = _TOKEN.search(page, position)
        start = found.start() if found else size
        if start > position and not dropping:
            held.append(page[position:start])
            if in_link:
                link_held.append(page[position:start])
        if not found:
            break
        position = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing = name.lower(), bool(found[1] or found[4])
        attributes = found[3] or found[6] or ""
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if dropping in ENDED_BY:
            inside = closing and name in inner
            # a block's end tag that nothing open inside has is that of an element around
            around = closing and not inside and name in BLOCKS and name not in (dropping, "p")
            if not closing:
                while inner and name in ENDED_BY.get(inner[-1], ()):
                    inner.pop()
            if around or not closing and (name in CONTAINERS or name in ENDED_BY[dropping] and _open_ends(dropping, inner)):
                dropping = ""  # ended without an end tag; this tag counts
            else:
                if inside:
                    while inner.pop() != name:
                        pass
                elif closing and name == dropping:
                    dropping = ""
                elif not closing and name in BLOCKS and name not in VOID and not attributes.endswith("/"):
                    inner.append(name)
                continue
        elif dropping:
            if name == dropping:
                level += -1 if closing else not attributes.endswith("/")
                if level <= 0:
                    dropping = ""
                continue
            if closing or name not in CONTAINERS or dropping in CONTAINERS or replies:
                continue
            dropping = ""  # an article begins: the dropped element was never closed
        if name == "br":
            held.append(" ")
        elif name == "a":
            in_link = not closing
        elif not closing and name not in VOID and _unwanted(name, attributes, depth):
            if not attributes.endswith("/"):
                flush()
                gap(WINDOW if name in ENDING else 1)
                dropping, level = name, 1
                replies = name == "aside" or not REPLIES.isdisjoint(_marks(name, attributes))
                inner.clear()
        elif name in BLOCKS:
            flush()
            if name in CONTAINERS:
                gap()
                depth = max(0, depth + (-1 if closing else 1))
                gap()
            in_link = False
    flush()
    return out


def weights(found: list[tuple[str, bool]]) -> list[int]:
    """What each line weighs."""
    total = sum(len(text) for text, _ in found)
    inside = sum(len(text) for text, article in found if article)
    factor = ARTICLE_WEIGHT if inside and inside >= ARTICLE_SHARE * total else 1
    return [len(text) * (factor if article else 1) for text, article in found]


def stretches(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, largest sum) of the lines between each surge and its dive."""
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    out, begin = [], None
    for i, total in enumerate([*sums, 0]):
        if begin is None and total > SURGE and sizes[i]:
            begin = i
        elif begin is not None and not total:
            out.append((begin, i, max(sums[begin:i])))
            begin = None
    return out


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by newlines; empty for a null or empty page, or one without text."""
    found = lines(page or "")
    sizes = weights(found)
    kept = stretches(sizes)
    if not kept:
        at = [i for i, size in enumerate([*sizes, 0]) if not size]
        kept = [(a, b, sum(sizes[a:b])) for a, b in zip([0, *(i + 1 for i in at)], at, strict=False)]
        kept = [max(kept, key=lambda x: x[2])]
    least = STRETCH_SHARE * max(top for *_, top in kept)
    return "\n".join(found[i][0] for a, b, top in kept if top >= least for i in range(a, b) if sizes[i])


def _extract(out: str):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(page) for page in string_column(piece, "html").to_pylist()]
                yield replaced(piece, **{out: pa.array(texts, pa.string())})

    return run


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """The pages with their main text in ``out``. All other columns, null and repeated rows stay as they are; an empty table stays empty."""
    return map_batches(pages, _extract(out), with_fields(pages, StructField(out, StringType())))


def op5(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html counts as empty."""
    rows = extract(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))
    return rows.select("page_id", "url", "text", F.char_length("text").cast(LongType()).alias("n_chars"))

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. A line's length is its text outside links; lines of page furniture
(menus, headers, footers, side bars, forms, adverts, notices, reader comments) and hidden ones count as empty. Furniture
goes by tags and names, hidden is the attribute, aria-hidden=true or the style; body, main and article are neither, nor
is an element that holds the page's marked article (the longest one, where there are several). Where a page marks its
article, that only weighs lines: those inside count `INSIDE` times with their links, and if they so outweigh the text
outside, that counts as empty; if not, the mark is of something else and weighs nothing.

Lengths are summed over windows of `WINDOW` lines. The text surges where the sum reaches the surge point, `SURGE` or, on
a page that never gets far, `SHARE` of its highest sum, and dives where a whole window is empty; the lines between every
surge and its dive are kept, those of links alone too, furniture never.

Defined results: a null page, or one without such text, gives an empty string; unclosed or cut off markup ends with the
page; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WINDOW, SURGE, SHARE = 3, 20, 0.5
INSIDE = 4
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|title|textarea|noscript|iframe|svg|template|select|button)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("nav footer aside form dialog menu head".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMES = ("class", "id", "role", "itemprop", "aria-label")
_STATE = re.compile(r"(?<![a-z0-9])(?:has|no|not|with|without)[-_][\w-]*", re.I)  # says what an element has, not what it is
_FURNITURE_NAME = re.compile(
    r"(?:^|[\s\"'_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|footer|masthead|site-header|page-header|share|sharing|social|related|recommended|"
    r"comments?|disqus|respond|replies|toolbar|widget|complementary|contentinfo|search|login|gdpr)(?=$|[\s\"'_-])",
    re.I,
)
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_CONTENT = frozenset("html body main article".split())


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, length outside links, furniture, inside the marked article) of every block that has text."""
    out: list[tuple[str, int, tuple[int, ...], int]] = []
    stack: list[tuple[str, tuple[int, ...], int]] = []  # name; furniture and article outside it
    held: list[str] = []
    free = 0
    link = article = 0  # article: the place of the outermost mark
    furniture: tuple[int, ...] = ()  # the places of the furniture elements that are open
    around: dict[int, tuple[int, ...]] = {}  # the furniture around each outermost mark

    def end() -> None:
        nonlocal free
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, free, furniture, article))
            held.clear()
        free = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            free += 0 if link else len(piece.strip())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            end()
        if name == "a":
            link = max(0, link + (-1 if m[2] else 1))
        if name in _INLINE or name in _VOID:
            continue
        if m[2]:
            if any(n == name for n, _, _ in stack):
                while stack:
                    n, furniture, article = stack.pop()
                    if n == name:
                        break
                link = 0
            continue
        attrs = m[4] or ""
        if attrs.endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            _, furniture, article = stack.pop()
        mark = name in ("article", "main")
        given = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attrs))} if attrs else {}
        named = " ".join(given[k] for k in _NAMES if k in given)
        odd = name in _FURNITURE or (name == "header" and not article)
        if given and name not in _CONTENT:
            hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(given.get("style", ""))
            odd = odd or bool(hidden or _FURNITURE_NAME.search(_STATE.sub("", named)))
        mark = mark or (bool(named) and re.search(r"\bmain\b|articleBody|article-body|entry-content|post-content", named) is not None and not odd)
        stack.append((name, furniture, article))
        if odd:
            furniture = (*furniture, m.start() + 1)
        if mark and not article:
            article = m.start() + 1
            around[article] = furniture
    if at < len(page):
        rest = page[at:]
        held.append(rest)
        free += 0 if link else len(rest.strip())
    end()
    # the longest marked article is the page's: what holds it is neither hidden nor furniture
    size: dict[int, int] = {}
    for text, _, f, a in out:
        if a and f == around[a]:
            size[a] = size.get(a, 0) + len(text)
    spared = set(around[max(size, key=size.__getitem__)]) if size else set()
    return [(text, n, not spared.issuperset(f), a > 0) for text, n, f, a in out]


def weights(rows: list[tuple[str, int, bool, bool]]) -> list[int]:
    """What each line counts in the distribution."""
    inside = [INSIDE * len(t) if a and not f else 0 for t, _, f, a in rows]
    outside = [n if not (a or f) else 0 for _, n, f, a in rows]
    if sum(inside) and sum(inside) >= sum(outside):
        return inside
    return [0 if f else n for _, n, f, _ in rows]


def regions(size: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) line ranges of the distribution."""
    n = len(size)
    sums = [sum(size[i : i + WINDOW]) for i in range(n)]
    surge = min(SURGE, SHARE * max(sums, default=0))
    out, i = [], 0
    while i < n:
        if not size[i] or sums[i] < surge:
            i += 1
            continue
        j = i  # its dive is where a whole window is empty
        while j < n and sums[j] > 0:
            j += 1
        out.append((i, j))
        i = j
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    return " ".join(rows[k][0] for i, j in regions(weights(rows)) for k in range(i, j) if not rows[k][2])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(_extracted), "page_id long, url string, text string, n_chars long")

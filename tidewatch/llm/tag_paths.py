"""Main text of web pages by tag-path ratios.

Every text block has the path of tags from the root to it. Over a page, text length and punctuation are averaged per path,
smoothed along the page, and fused; paths whose fused ratio passes a threshold are content. Blocks that stand in the same
container as content (a headline, a short list) belong to it. Elements that are never main text by their tag or role do not
take part; neither do elements named as page parts, unless they hold a main element, comment threads, unless they hold a main element
with most of the page's text, and forms, unless they hold a main element or most of the page's text. Of several articles the much
shorter ones are teasers. A page is parsed and judged on its own, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices

SPREAD = 1.0  # of the smoothing, in blocks
LEVEL = 0.5  # threshold in standard deviations of the fused ratios
TEASER = 0.3  # an article of less than this share of the longest one's text is a teaser
MAIN_WEIGHT = 8.0  # of paths through an element that says it is the main text

# Names of the markup language and of common page parts.
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "audio", "video"}
_ASIDE = {"head", "nav", "header", "footer", "aside", "button", "select", "menu", "dialog", "label"}
_FORM = {"form", "fieldset"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
           "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
           "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
# Page parts whose name counts anywhere in a class name or id, or only as the whole or its last word.
_COMMENT_NAMES = {"comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus"}
_PART_NAMES = {"adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
               "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "sidebar", "footer", "related",
               "sharing", "navbar", "navigation"}
_LAST_NAMES = {"ad", "ads", "banner", "notification", "alert", "popup", "modal", "subscription", "nav", "menu", "widget", "share", "social",
               "header", "masthead", "login", "signup", "form", "search", "pagination", "pager", "hidden"}
# Words that make a name say something about the element instead of naming it.
_MODIFIERS = {"has", "no", "not", "non", "with", "without", "is", "open", "closed", "free", "category", "tag"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in _ASIDE:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role", "").lower() in _ASIDE_ROLES:
        return True
    return False


_COMMENTS, _PART, _AROUND = 1, 2, 3


def _named_part(tag: str, attributes: str) -> int:
    """What an element is by its names: a comment thread, another page part, a form (_AROUND), or nothing of these (0)."""
    if attributes.strip() and tag not in ("html", "body", "main"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        part = 0
        for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not words or not _MODIFIERS.isdisjoint(words):
                continue
            if not _COMMENT_NAMES.isdisjoint(words):
                return _COMMENTS
            if tag != "article" and (words[-1] in _LAST_NAMES or not _PART_NAMES.isdisjoint(words)):
                part = _PART
        if part:
            return part
    return _AROUND if tag in _FORM else 0


class _Element:
    """An open or closed element that may not take part, or an article."""

    def __init__(self, depth: int, kind: int) -> None:
        self.depth, self.kind, self.text = depth, kind, 0
        self.mains: list[_Element] = []  # main elements inside that are no comments


def _kept(element: _Element, total: int) -> bool:
    if element.kind == _COMMENTS:
        return any(2 * m.text >= total for m in element.mains)
    return bool(element.mains) or element.kind == _AROUND and 2 * element.text > total


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(tag path, text) of each block that may be main text, in page order. Broken markup is read as far as it goes."""
    path: list[str] = []
    asides: list[int] = []  # depths at which elements that don't take part began
    named: list[_Element] = []  # open elements that may not take part, and main elements
    found: list[tuple[tuple[str, ...], str]] = []
    within: list[tuple[_Element, ...]] = []  # such elements around each block
    pieces: list[str] = []
    at: tuple[str, ...] = ()
    inside: tuple[_Element, ...] = ()

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            found.append((at, text))
            within.append(inside)
        pieces.clear()

    def close(depth: int) -> None:
        del path[depth:]
        while asides and asides[-1] >= depth:
            asides.pop()
        while named and named[-1].depth >= depth:
            named.pop()

    def add(raw: str) -> None:
        nonlocal at, inside
        if raw and not asides:
            if not pieces:
                at = tuple(t for t in path if t not in _INLINE)
                inside = tuple(named)
            pieces.append(html.unescape(raw))

    begin, end = 0, len(page)
    while begin < end:
        match = _TOKEN.search(page, begin)
        if match is None:
            add(page[begin:])
            break
        add(page[begin : match.start()])
        begin = match.end()
        closing, tag, attributes = match.group(1), (match.group(2) or "").lower(), match.group(3) or ""
        if not tag:
            continue
        if tag not in _INLINE and tag != "br":
            flush()
        if tag == "br":
            add(" ")
        elif closing:
            for depth in range(len(path) - 1, -1, -1):
                if path[depth] == tag:
                    close(depth)
                    break
                if path[depth] in _MAIN and tag in _INLINE:
                    break
        elif tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, begin)
            begin = end if stop is None and not attributes.rstrip().endswith("/") else begin if stop is None else stop.end()
        elif tag not in _VOID:
            ends = {"p"} if tag in _ENDS_P else _SAME_ENDS.get(tag, ())
            for depth in range(len(path) - 1, -1, -1):
                if path[depth] in ends:
                    close(depth)
                    break
                if path[depth] not in _INLINE:
                    break
            if tag in ("body", "article", "main") and "head" in path:
                close(path.index("head"))
            if not attributes.rstrip().endswith("/"):
                part = _named_part(tag, attributes)
                if _is_aside(tag, attributes) or part and tag in _INLINE:
                    asides.append(len(path))
                elif part or tag in _MAIN:
                    element = _Element(len(path), part)
                    if not part and not asides:
                        for around in named:
                            around.mains.append(element)
                    named.append(element)
                path.append(tag)
    flush()
    total = 0
    for (_, text), around in zip(found, within, strict=True):
        total += len(text)
        for element in around:
            element.text += len(text)
    left = [(block, around) for block, around in zip(found, within, strict=True) if all(not e.kind or _kept(e, total) for e in around)]
    # articles that stand in no other one; a main element around them is no article
    outer = {id(next((e for e in around if not e.kind and not e.mains), None)): 0 for _, around in left}
    for (_, text), around in left:
        outer[id(next((e for e in around if not e.kind and not e.mains), None))] += len(text)
    outer.pop(id(None), None)
    longest = max(outer.values(), default=0)
    teasers = {e for e, size in outer.items() if size < TEASER * longest}
    return [block for block, around in left if not any(id(e) in teasers for e in around)]


def content(found: list[tuple[tuple[str, ...], str]]) -> list[bool]:
    """Which blocks are main text, by the smoothed and fused ratios of their paths."""
    if not found:
        return []
    length: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, text in found:
        sums = length[path]
        sums[0] += 1
        sums[1] += len(text)
        sums[2] += len(_PUNCTUATION.findall(text))
    ratios = np.array([[length[p][1] / length[p][0], (1 + length[p][2]) / length[p][0]] for p, _ in found])
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * SPREAD**2))
    padded = np.pad(ratios, ((2, 2), (0, 0)))
    weight = np.convolve(np.pad(np.ones(len(found)), 2), kernel, "valid")
    smooth = np.column_stack([np.convolve(padded[:, c], kernel, "valid") / weight for c in (0, 1)])
    main = np.array([not _MAIN.isdisjoint(p) for p, _ in found])
    fused = np.sqrt(ratios * smooth).prod(axis=1) * np.where(main, MAIN_WEIGHT, 1.0)
    threshold = min(LEVEL * fused.std(), fused.max())
    score: dict[tuple[str, ...], float] = defaultdict(float)
    for (path, _), value in zip(found, fused, strict=True):
        score[path] = max(score[path], value)
    chosen = {p for p, s in score.items() if s >= threshold}
    if any(not _MAIN.isdisjoint(p) for p in chosen):  # the page says where its main text is
        roots = {p[: 1 + max(i for i, t in enumerate(p) if t in _MAIN)] for p in chosen if not _MAIN.isdisjoint(p)}
        return [any(p[: len(r)] == r for r in roots) for p, _ in found]
    parents = {p[:-1] for p in chosen}
    return [p in chosen or p[:-1] in parents for p, _ in found]


def main_text(page: str | None) -> str:
    """The page's main blocks joined by empty lines; "" if it has none, or for a null page."""
    found = blocks(page or "")
    return "\n\n".join(text for (_, text), keep in zip(found, content(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null and empty pages give an empty text; only these columns are read."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page) for page in batch["html"].to_pylist()]
            yield pa.record_batch({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(compute, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs its text outside links, HOME times as
much inside article and main. Weights are summed over sliding windows of BLOCK lines that do not run over the
edge of a container: text surges where a sum exceeds SURGE and dives where a whole window weighs nothing. The
text lies in the smallest container that holds MOST of the weight of all surges, from its first surge to its
last dive; short lines beside them in that container, and headings just before, belong to it. Where body
itself is that container, it goes from the first surge to the last dive, with what lies between, and a
copyright line may not end it.

What the page itself calls furniture is left out beforehand: elements such as nav, footer and form, roles,
and names in class or id. A name counts if all its words are words of furniture or of layout (share-buttons,
but not search-results). Words that articles use as well (related, legal) are no verdict but halve into dense
and thin: a container so called stays if its text outside links exceeds SURGE and its links.

Scale: one pass, a page at a time, no shuffle; a page's work is linear in its length (close tags are looked
up in one index, containers below DEEPEST are not told apart).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches

BLOCK = 3
SURGE = 60
HOME = 4
#: Share of the weight of all surges, as a fraction.
MOST = (2, 3)
#: Containers below so many are not told apart.
DEEPEST = 64

#: Element names of HTML by their part on a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
FURNITURE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "center", "details"} | FURNITURE
BLOCKS = CONTAINERS | set(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre figure figcaption address hr fieldset legend summary option".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar", "alert"}
#: Words in class and id that name page furniture, words that may, and words of layout beside them.
STRONG = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion promoted banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu topnav breadcrumb breadcrumbs sidebar "
    "aside footer comment comments commentlist disqus reply replies respond social share sharing sharebar toolbar login pagination pager pagenav paywall".split()
)
WEAK = set("related recommended recommendations teaser teasers widget widgets search copyright legal skip side rail foot alert hero".split())
LAYOUT = set(
    "box block wrap wrapper container inner outer top bottom left right center main site page global primary secondary header head list item items bar area "
    "section content button buttons link links icon icons group row col column panel slot unit zone space post posts article articles entry reader user "
    "story news blog title text form sticky fixed mobile desktop small large js".split()
)
TOP, TOP_LAYOUT = {"header", "masthead", "topbar"}, set("site page top main global bar inner wrap wrapper container".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]|=)*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>?")


def _named(names: str, inside: bool) -> int:
    """2 if a name in class or id is one of furniture, 1 if it may be, else 0."""
    out = 0
    for name in names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & STRONG and words <= STRONG | WEAK | LAYOUT or not inside and words & TOP and words <= TOP | TOP_LAYOUT:
            return 2
        if words & WEAK and words <= WEAK | LAYOUT:
            out = 1
    return out


def _furniture(name: str, attributes: str, inside: bool, marks: bool) -> int:
    """2 for furniture, 1 for what may be; ``inside``: in an article or main element."""
    if name in FURNITURE or (name == "header" and not inside):
        return 2
    if not attributes.strip() or name in ("html", "body"):
        return 0
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return 2
    if found.get("role", "").lower() in ROLES:
        return 2
    return _named(found.get("class", "") + " " + found.get("id", ""), inside) if marks else 0


class _Lines:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []
        self.links: list[int] = []
        self.home: list[bool] = []
        self.heading: list[bool] = []
        self.boxes: list[tuple[int, ...]] = []
        self.doubtful: list[int] = []
        self._now: list[str] = []
        self._linked = 0

    def add(self, text: str, linked: bool) -> None:
        self._now.append(text)
        if linked:
            self._linked += len(text.strip())

    def close(self, home: bool, heading: bool, boxes: tuple[int, ...], doubtful: int) -> None:
        if self._now:
            line = " ".join(html.unescape("".join(self._now)).split())
            if line:
                links = min(len(line), self._linked)
                for column, x in zip((self.text, self.weight, self.links, self.home, self.heading, self.boxes, self.doubtful), (line, len(line) - links, links, home, heading, boxes, doubtful), strict=True):
                    column.append(x)
            self._now, self._linked = [], 0

    def drop(self, gone: set[int]) -> None:
        """Without the lines of these doubtful containers."""
        keep = [d not in gone for d in self.doubtful]
        for name in ("text", "weight", "links", "home", "heading", "boxes", "doubtful"):
            setattr(self, name, [x for x, ok in zip(getattr(self, name), keep, strict=True) if ok])


def lines_of(page: str, marks: bool = True) -> _Lines:
    """The page's lines outside furniture, with weights.

    home: in an article or main element; boxes: numbers of the open containers but html and body; doubtful:
    number of the container that may be furniture, or 0.
    """
    out = _Lines()
    closes: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSE.finditer(page):
        closes.setdefault(m[1].lower(), []).append((m.start(), m.end()))

    def behind(name: str, at: int) -> int | None:
        """Where the next close tag of this name ends."""
        own = closes.get(name, [])
        k = bisect_left(own, (at, 0))
        return own[k][1] if k < len(own) else None

    stack: list[tuple] = []  # element, and the state before it
    furniture = home = heading = aside = False
    boxes: tuple[int, ...] = ()
    doubtful = links = opened = at = 0
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not furniture and not aside:
            out.add(page[at:end], links > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                at = behind(name, at) or (at if name in ("noscript", "template", "svg") else n)
        elif name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            if not furniture and not aside:
                out.add(" ", False)
        elif name in BLOCKS:
            out.close(home, heading, boxes, doubtful)
            links, aside = 0, False
            heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name in CONTAINERS and closing:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                    if stack[k][0] == name:
                        _, furniture, home, boxes, doubtful = stack[k]
                        del stack[k:]
                        break
            elif name in CONTAINERS and not attributes.rstrip().endswith("/"):
                stack.append((name, furniture, home, boxes, doubtful))
                if name not in ("html", "body"):
                    opened += 1
                    boxes = (*boxes, opened) if len(boxes) < DEEPEST else boxes
                if not furniture:
                    kind = _furniture(name, attributes, home, marks)
                    furniture = kind == 2
                    doubtful = doubtful or (opened if kind else 0)
                    home = home or not furniture and (name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main", attributes)))
            elif not closing and not furniture and attributes.strip() and _furniture(name, attributes, home, marks) == 2:
                # furniture by itself: up to its close tag, or a paragraph's next block
                to = None if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") else behind(name, at)
                at, aside = to or at, to is None
        elif not closing and name in ("span", "ins", "label") and not furniture and attributes.strip() and _furniture(name, attributes, True, marks) == 2:
            at = behind(name, at) or at
    out.close(home, heading, boxes, doubtful)
    # a container that may be furniture stays if it is dense
    tally: dict[int, list[int]] = {}
    for d, w, x in zip(out.doubtful, out.weight, out.links, strict=True):
        if d:
            own = tally.setdefault(d, [0, 0])
            own[0] += w
            own[1] += x
    out.drop({d for d, (w, x) in tally.items() if w <= SURGE or w < x})
    return out


_COPYRIGHT = re.compile(r"©|\(c\)|copyright\b", re.I)


def _surges(lines: _Lines, weight: list[int]) -> list[tuple[int, int]]:
    """Stretches of lines, each in one container and what it holds: from a surge to the next dive."""
    n = len(weight)
    inside = lambda i, j: lines.boxes[j][: len(lines.boxes[i])] == lines.boxes[i] or lines.boxes[i][: len(lines.boxes[j])] == lines.boxes[j]
    sums = []
    for i in range(n):
        total = weight[i]
        for j in range(i + 1, min(i + BLOCK, n)):
            if not inside(i, j):
                break
            total += weight[j]
        sums.append(total)
    out, i = [], 0
    while i < n:
        if sums[i] <= SURGE * (HOME if lines.home[i] and weight[i] > lines.weight[i] else 1):
            i += 1
            continue
        start = i
        while not weight[start]:
            start += 1  # the window surges before its first line does
        stop = start + 1
        while stop < n and sums[stop] > 0 and inside(start, stop):
            stop += 1
        out.append((start, stop))
        i = max(stop, i + 1)
    return out


def _container(lines: _Lines, weight: list[int], surges: list[tuple[int, int]]) -> tuple[int, ...]:
    """Path of the smallest container that holds MOST of the surges' weight; body's is empty.

    A container of one line is a paragraph, unless it is in an article or main.
    """
    held: dict[int, int] = {}
    size: dict[int, int] = {}
    for boxes, home in zip(lines.boxes, lines.home, strict=True):
        for box in boxes:
            size[box] = size.get(box, 0) + (2 if home else 1)
    path: dict[int, tuple[int, ...]] = {}
    total = 0
    for start, stop in surges:
        for k in range(start, stop):
            total += weight[k]
            for depth, box in enumerate(lines.boxes[k]):
                held[box] = held.get(box, 0) + weight[k]
                if box not in path:
                    path[box] = lines.boxes[k][: depth + 1]
    return max((p for box, p in path.items() if size[box] > 1 and held[box] * MOST[1] >= total * MOST[0]), key=len, default=())


def main_text(page: str | None, marks: bool = True, home: int = HOME) -> str:
    """Blocks of the main text, joined by an empty line; empty for null, empty and textless pages.

    Without ``marks`` names in class and id mean nothing, with ``home`` 1 article and main are plain containers.
    """
    if not page:
        return ""
    lines = lines_of(page, marks)
    n = len(lines.text)
    weight = [w * home if h else w for w, h in zip(lines.weight, lines.home, strict=True)]
    surges = _surges(lines, weight)
    if not surges:
        keep = [k for k in range(n) if lines.home[k]] if home > 1 and any(lines.home) else list(range(n))
        return "\n\n".join(lines.text[k] for k in keep)
    path = _container(lines, weight, surges)
    own = [k for k in range(n) if lines.boxes[k][: len(path)] == path]
    if path:
        start, stop = 0, len(own)
        # beyond the last dive, and before the first surge: whole windows without weight
        while stop - BLOCK >= 0 and not any(weight[k] for k in own[stop - BLOCK : stop]):
            stop -= 1
        while start + BLOCK <= stop and not any(weight[k] or lines.heading[k] for k in own[start : start + BLOCK]):
            start += 1
        if stop < len(own):
            while stop and not weight[own[stop - 1]]:
                stop -= 1
        if start:
            while start < stop and not (weight[own[start]] or lines.heading[own[start]]):
                start += 1
        return "\n\n".join(lines.text[k] for k in own[start:stop])
    start, stop = surges[0][0], surges[-1][1]
    # short lines of the containers at the ends, of body only its own
    for at, step in ((start, -1), (stop - 1, 1)):
        box, k = lines.boxes[at], at + step
        while 0 <= k < n and (lines.boxes[k][: len(box)] == box if box else not lines.boxes[k]):
            if weight[k]:
                start, stop = min(start, k), max(stop, k + 1)
            k += step
    while start and lines.heading[start - 1]:
        start -= 1
    keep = lines.text[start:stop]
    while keep and _COPYRIGHT.match(keep[-1]):
        if keep[-1][:3] == "(c)" and len(keep) > 1 and keep[-2].startswith("(b)"):
            break  # an item of a list
        keep.pop()
    return "\n\n".join(keep)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; n_chars counts code points.

    A null or empty html gives an empty text; null ids and urls are kept; repeated rows are each extracted. A
    page of any length is read whole; its task holds some ten times its bytes. An empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")

"""HTML extraction: two passes over the blocks of a page.

A page is cut at block elements. Text within navigation, footers, asides, forms, dialogs and page headers is out, and so is what class, id or role name as advert, notice, menu, comments and
the like: by a whole name, or by the first or last part of one ("ad-slot", "site-footer"), which counts less: it never excludes an article element or what holds one. A page
without an article element from which nothing would be left keeps the named containers that hold most of its text.

The first pass gives every other block points: two for its density of stop words (4 and 12 hundredths, of five words and more), and with these two for its length (15 and 40 words); five
less for text that is mostly links, unless it is a heading; two more within an article element. Outside the page's article elements two less if these hold at least half of the
page's text that is no link, else nothing less. With three points a block is in, below none it is out. So a link list or a linked teaser within an article goes, long prose beside a small article stays.

What stays open, short blocks above all, takes the label of the nearest decided block in the second pass (headings that of the
block that follows; at even distance the one before decides, as a text's short last lines stand before what isn't text). Blocks of an article look at its decided blocks, so a line between links
goes with them; if none of the page's article blocks is in, its open ones are. Character references are decoded, white space within a block is one space, blocks stand in page order with an
empty line between.

Defined results: null or empty html, or nothing left, gives the empty text. Null ids and urls keep their rows, rows repeat as given.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import pieces
from .common import chunks, small_batches

# fixed values of the format: elements by what they do to the text
CUT = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HELD = CUT - frozenset("body caption center dd dt h1 h2 h3 h4 h5 h6 hr html legend li p pre summary".split())
SILENT = frozenset("script style noscript template svg math textarea select button iframe object canvas title head video audio".split())
OUTSIDE = frozenset("nav footer aside form dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role names that mark what isn't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: First parts of names that say something of the rest.
ABOUT = frozenset("has is no not with without".split())
#: Frequent words of the languages of the pages.
STOP = frozenset(
    "a an and are as at be by for from has he her his in is it its not of on or she that the their they this to was were which who will with you "
    "als am auf aus bei das dass dem den der des die ein eine einen einer er es für im in ist mit nicht sich sie sind und von war wie zu zum "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas pour qui que se son sont sur un une "
    "al como con del el ella en es esta ha la las lo los más no para pero por que se su sus un una y".split()
)

_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"\w+")
IN, OUT, OPEN = 1, -1, 0


class Block(NamedTuple):
    text: str
    linked: int  #: characters within links
    article: bool
    outside: bool  #: by its element
    named: int  #: the innermost container whose name may exclude it, -1 for none
    kind: str  #: the element that began it


def named_out(attributes: str, article: bool = False) -> bool:
    """Whether a class, id or role names what isn't the article; for an article element itself whole names only."""
    if "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in "".join(m.groups("")).lower().split():
            parts = re.split(r"[_-]+", name)
            if name in NAMES or not article and parts[0] not in ABOUT and (parts[0] in NAMES or parts[-1] in NAMES):
                return True
    return False


class Containers(NamedTuple):
    """Those that are named as something else than the article, outer ones before inner ones."""

    parent: list[int]
    holds: list[bool]  #: an article element
    size: list[int]  #: characters

    def add(self, within: int) -> int:
        self.parent.append(within)
        self.holds.append(False)
        self.size.append(0)
        return len(self.parent) - 1

    def excluded(self, most: int) -> list[bool]:
        """Which of them go: none that holds an article element or more than so many characters, and what stands in one that goes."""
        out: list[bool] = []
        for around, holds, size in zip(*self, strict=True):
            out.append(around >= 0 and out[around] or not holds and size <= most)
        return out


def blocks(page: str) -> tuple[list[Block], Containers, bool]:
    """The blocks of a page, its named containers, and whether it has an article element."""
    out: list[Block] = []
    held: list[tuple[str, bool, bool, int]] = []  # open containers: name, within an article, outside, innermost named container
    open_ones: Counter[str] = Counter()  # by name
    containers = Containers([], [], [])
    parts: list[str] = []
    linked = links = 0
    kind, own = "", -1
    has_article = False

    def close() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            _, inside, outside, named = held[-1] if held else ("", False, False, -1)
            named = named if own < 0 else own
            out.append(Block(text, linked, inside, outside, named, kind))
            if named >= 0:
                containers.size[named] += len(text)
        parts.clear()
        linked = 0

    for name, end, attributes, text in pieces(page, SILENT):
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
        elif name == "br" or name in SILENT and not end:
            parts.append(" ")
        elif name == "a":
            links = max(0, links - 1) if end else links + 1
        elif name in CUT:
            close()
            links = 0
            kind, own = "", -1
            if end:
                while name in HELD and open_ones[name]:
                    last = held.pop()[0]
                    open_ones[last] -= 1
                    if last == name:
                        break
                continue
            kind = name
            article = name in ("article", "main")
            named = name not in ("body", "html") and named_out(attributes, article)
            if name in HELD:
                if article and not named:
                    while held and held[-1][0] in ("nav", "header", "ul", "ol"):  # left open
                        open_ones[held.pop()[0]] -= 1
                _, inside, outside, within = held[-1] if held else ("", False, False, -1)
                if article and not named:
                    has_article = True
                    if within >= 0:
                        containers.holds[within] = True
                outside = outside or name in OUTSIDE or (name == "header" and not inside)
                held.append((name, inside or article, outside, containers.add(within) if named else within))
                open_ones[name] += 1
            elif named:
                own = containers.add(held[-1][3] if held else -1)
    close()
    parent, holds, size = containers
    for c in reversed(range(len(parent))):
        if parent[c] >= 0:
            holds[parent[c]] |= holds[c]
            size[parent[c]] += size[c]
    return out, containers, has_article


def evidence(b: Block, away: int) -> int:
    """Points for a block by its length, the density of stop words and of links, and where it stands; away is what standing outside an article costs."""
    words = _WORD.findall(b.text.lower())
    n = len(words)
    stops = sum(w in STOP for w in words) / max(1, n)
    points = 0
    if n >= 5 and stops >= 0.04:
        points = 1 + (stops >= 0.12) + (n >= 15) + (n >= 40)
    if b.linked > 0.5 * len(b.text) and b.kind not in HEADINGS:
        points -= 5 if not b.article else 7
    return points + (2 if b.article else -away)


def decide(points: int) -> int:
    return IN if points >= 3 else OUT if points < 0 else OPEN


def nearest(labels: list[int], kinds: list[str], asking: list[bool], asked: list[bool]) -> list[int]:
    """The labels, where open blocks that ask have taken that of the nearest decided one among the asked, at even distance that of the one before; headings that of the
    one behind. Without any an open block is in."""
    n = len(labels)
    out = list(labels)
    seen = [labels[i] if asked[i] else OPEN for i in range(n)]
    after, last = [(n, OPEN)] * n, (n, OPEN)
    for i in reversed(range(n)):
        after[i] = last = (i, seen[i]) if seen[i] != OPEN else last
    before, label = -1, OPEN
    for i in range(n):
        if seen[i] != OPEN:
            before, label = i, seen[i]
        elif labels[i] == OPEN and asking[i]:
            behind, other = after[i]
            if label == OPEN or other == OPEN:
                out[i] = label or other or IN
            else:
                out[i] = other if kinds[i] in HEADINGS or behind - i < i - before else label
    return out


def judged(found: list[Block], out: list[bool]) -> list[int]:
    """Both passes: the label of every block, of which some are out by their place."""
    article = [b.article and not o for b, o in zip(found, out, strict=True)]
    prose = [0 if o else len(b.text) - b.linked for b, o in zip(found, out, strict=True)]
    within = sum(p for p, a in zip(prose, article, strict=True) if a)
    away = 2 if any(article) and 2 * within >= sum(prose) else 0
    labels = [OUT if o else decide(evidence(b, away)) for b, o in zip(found, out, strict=True)]
    kinds = [b.kind for b in found]
    if IN not in (x for x, a in zip(labels, article, strict=True) if a):
        labels = [IN if a and x == OPEN else x for x, a in zip(labels, article, strict=True)]
    first = nearest(labels, kinds, article, article)
    return nearest([f if a else x for f, x, a in zip(first, labels, article, strict=True)], kinds, [not a for a in article], [True] * len(found))


def main_text(page: str) -> str:
    found, containers, has_article = blocks(page)

    def text(most: int) -> str:
        goes = containers.excluded(most)
        labels = judged(found, [b.outside or b.named >= 0 and goes[b.named] for b in found])
        return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label == IN)

    total = sum(len(b.text) for b in found)
    main = text(total)
    return main if main or has_article or not containers.parent else text(total // 2)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(p or "") for p in batch.column("html").to_pylist()]
            yield pa.record_batch([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

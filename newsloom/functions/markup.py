"""Tags and text of HTML pages, in time that grows with the page however broken its markup is."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

#: A tag whose quoted values hold neither < nor >; it ends before the next < at the latest.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_TAG_NAME = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)""")
_EDGE = re.compile("""[>"']""")


def pieces(page: str, silent: frozenset[str], optional: frozenset[str] = frozenset({"head"})) -> Iterator[tuple[str, bool, str, str]]:
    """(name, is_end, attributes, text) of a page's tags (lower-case name, no text) and of the text between them (no name), in page order.

    Comments and declarations give nothing. After a start tag of a silent element the page goes on behind its end tag; without one
    nothing follows, but for the optional ones. A tag ends at the first > outside quotes, or, if a quote never closes, at the first > of all; a < that no > follows, or that
    begins no name, is text."""
    at, n, last = 0, len(page), page.rfind(">")
    edges: list[int] = []
    failed: set[int] = set()  # opening quotes from which no tag ends
    unclosed: set[str] = set()

    def tag_end(start: int) -> int:
        if not edges:
            edges.extend(m.start() for m in _EDGE.finditer(page))
        k, seen = bisect_left(edges, start), []
        while k < len(edges):
            p = edges[k]
            if page[p] == ">":
                return p
            if p in failed:
                break
            seen.append(p)
            close = page.find(page[p], p + 1)
            if close < 0:
                break
            k = bisect_left(edges, close) + 1
        failed.update(seen)
        return page.index(">", start)

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "", False, "", page[at:end]
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if at < last and page[at + 1] in "!?":
            at = page.index(">", at) + 1
            continue
        m = _PLAIN_TAG.match(page, at)
        if m:
            slash, name, attributes = m.groups()
            at = m.end()
        else:
            m = _TAG_NAME.match(page, at) if at < last else None
            if not m:
                yield "", False, "", "<"
                at += 1
                continue
            slash, name = m.groups()
            end = tag_end(m.end())
            attributes = page[m.end() : end]
            at = end + 1
        name = name.lower()
        yield name, bool(slash), attributes, ""
        if not slash and name in silent and not attributes.endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in optional:
                unclosed.add(name)
            else:
                at = n

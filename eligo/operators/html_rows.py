"""List rows of web pages: the group of elements that repeats most, each with a link, is the list."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that make a list, the share of dated rows that is preferred, letters of a title.
LEAST_LINKS, DATED, LEAST_TITLE = 3, 0.5, 4
_DAY = re.compile(r"20[0-9]{2}[.\-/](?:1[0-2]|0?[1-9])[.\-/](?:3[01]|[12][0-9]|0?[1-9])(?![0-9])")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset(("script", "style", "template"))
SCHEMA = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("day", pa.string())])
SCHEMA_SQL = "page_id long, ord int, title string, url string, day string"


class _Page(HTMLParser):
    """Elements with a link, by their place: (parent's number, tag). Text and links are held once for the whole page; an
    element knows where its own begin and end, so that depth costs nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int]] = []  # tag, number, first link, first letter
        self.depth: dict[str, int] = defaultdict(int)
        self.skipped = 0
        self.groups: dict[tuple[int, str], list[tuple[int, int, int, int]]] = defaultdict(list)  # links from, to; letters from, to
        self.links: list[list] = []  # address, letters from, to
        self.parts: list[str] = []
        self.n = self.at = 0

    def _text(self, part: str) -> None:
        self.parts.append(part)
        self.at += len(part)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        self._text(" ")
        self.n += 1
        self.depth[tag] += 1
        self.skipped += tag in _SKIPPED
        self.open.append((tag, self.n, len(self.links), self.at))
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append([href, self.at, self.at])

    def handle_endtag(self, tag: str) -> None:
        if self.depth[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and not self.skipped:
            self._text(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()

    def _close(self) -> str:
        tag, _, first, start = self.open.pop()
        self.depth[tag] -= 1
        self.skipped -= tag in _SKIPPED
        if first < len(self.links):
            if tag == "a":
                self.links[first][2] = self.at
            else:
                self.groups[(self.open[-1][1] if self.open else 0), tag].append((first, len(self.links), start, self.at))
        self._text(" ")
        return tag


def _closed(html: str) -> str:
    """Markup without comments, up to its last ">": an opened comment or tag that never ends holds no element, and the parser
    would look for its end again and again."""
    kept, at = [], 0
    while (start := html.find("<!--", at)) >= 0:
        kept.append(html[at:start])
        at = html.find("-->", start)
        if at < 0:
            html, at = "", 0
            break
        at += 3
    rest = "".join(kept) + html[at:]
    return rest[: rest.rfind(">") + 1].replace("<![", "<!")


def rows_of(html: str | None) -> list[tuple[str, str, str]]:
    """(title, url, day) of a page's list rows. A row's title is the longest of its links' texts, with LEAST_TITLE letters at least;
    lists with days in half of the rows go before others, then the longest, then the first. A null or empty page has none."""
    page = _Page()
    page.feed(_closed(html or ""))
    page.close()
    text = "".join(page.parts)
    days = [(m.start(), m[0]) for m in _DAY.finditer(text)]  # none goes over the space that is where an element ends
    starts = [d[0] for d in days]

    def day(start: int, end: int) -> str:
        k = bisect_left(starts, start)
        return days[k][1] if k < len(days) and starts[k] < end else ""

    best: tuple | None = None
    for (parent, _), members in page.groups.items():
        if len(members) >= LEAST_LINKS:
            dated = sum(bool(day(*m[2:])) for m in members) >= DATED * len(members)
            key = (dated, len(members), -parent)
            if best is None or key > best[0]:
                best = key, members
    found = []
    for first, last, start, end in best[1] if best else ():
        url, title = max(((href, " ".join(text[a:b].split())) for href, a, b in page.links[first:last]), key=lambda x: len(x[1]))
        if len(title) >= LEAST_TITLE:
            found.append((title, url, day(start, end)))
    return found


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, *row) for i, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, row in enumerate(rows_of(html))]
        columns = list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def list_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, ord, title, url, day) of the list rows of each page; pages without a list give none."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_extract, SCHEMA_SQL)

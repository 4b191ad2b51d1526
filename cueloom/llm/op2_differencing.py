"""Main text of web pages by structure and nearest-URL page differencing.

A page is cut into text blocks. Subtrees that are never main text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are left out by tag, role,
hidden state and class or id words. If the page marks its article (``article``, ``main``,
``role=main``, ``itemprop=articleBody``), the blocks inside are its text. Otherwise pages
are sorted by URL path within each host, each page is paired with its nearest neighbours
in that order, their lines are aligned by a longest common subsequence, and the lines
shared with a neighbour are deleted.

Differencing alone would be wrong on two kinds of pages: copies of one article would delete
each other, and menus that differ from page to page would stay. Hence the structural rules
above, and a neighbour that shares ``copy_share`` or more of a page's text is taken for a
copy of it and deletes nothing. Lines inside a marked article are never deleted.

Neighbours are rows next to each other in the order of (host, path, url, page_id), which
is range-sorted: a hot host spans many ranges. The ends of the ranges are found from the keys
alone; the first and last page of each range also go to the adjoining one, as neighbours
only, so the texts do not depend on where ranges end.

Defined results: null or empty html gives an empty text. A null url sorts first, under an
empty host. Rows that repeat are handled one by one; equal pages are copies. Other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY_SHARE = 0.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary"
    " table tbody td tfoot th thead tr ul br option".split()
)
NEVER = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe object svg"
    " canvas dialog menu audio video math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu form note".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie"
    " cookies consent gdpr notice notices notification popup modal overlay nav navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar footer comment comments disqus respond share sharing social related"
    " recommended newsletter subscribe signup login pagination pager toolbar widget masthead".split()
)
HEADERS = frozenset("header site-header page-header top-header global-header".split())
_PART = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _left_out(tag: str, attrs: dict[str, str | None]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return True
    if (attrs.get("role") or "").lower() in ROLES:
        return True
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        if name.lower() in HEADERS or WORDS & set(_PART.split(_CAMEL.sub("-", name).lower())):
            return True
    return False


def _is_main(tag: str, attrs: dict[str, str | None]) -> bool:
    return tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"


class _Blocks(HTMLParser):
    """Text blocks in page order, each with whether it lies in a marked article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.text: list[str] = []
        self.skip: list[str] = []  # open tags of the outermost left-out subtree
        self.main: list[str] = []  # open tags of the outermost marked article

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.blocks.append((text, bool(self.main)))

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        if self.skip == ["p"] and tag in BLOCKS:
            self.skip = []  # a paragraph ends where the next block begins
        if self.skip:
            if tag == self.skip[0] and tag not in VOID:
                self.skip.append(tag)
            return
        if tag in BLOCKS or tag in NEVER:
            self._end_block()
        if tag in VOID:
            return
        attrs = dict(pairs)
        if _left_out(tag, attrs):
            self.skip = [tag]
        elif self.main:
            if tag == self.main[0]:
                self.main.append(tag)
        elif _is_main(tag, attrs):
            self.main = [tag]

    def handle_startendtag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, pairs)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            elif tag in ("body", "html"):
                self.skip = []
            return
        if tag in BLOCKS:
            self._end_block()
        if self.main and tag == self.main[0]:
            self.main.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._end_block()


def blocks_of(html: str | None) -> tuple[list[str], bool]:
    """The candidate lines of a page, and whether they come from a marked article."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    inside = [t for t, main in parser.blocks if main]
    return (inside, True) if inside else ([t for t, _ in parser.blocks], False)


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Lines of ``a`` in a longest common subsequence with ``b``, by increasing matches."""
    where = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def deleted(lines: list[str], neighbours: list[list[str]], copy_share: float) -> set[int]:
    """The places of lines shared with a neighbour that is no copy."""
    total = sum(map(len, lines)) or 1
    gone: set[int] = set()
    for other in neighbours:
        shared = shared_lines(lines, other)
        if sum(len(lines[i]) for i in shared) < copy_share * total:
            gone |= shared
    return gone


def differenced(lines: list[str], neighbours: list[list[str]], copy_share: float) -> list[str]:
    """The lines without those shared with a neighbour that is no copy."""
    gone = deleted(lines, neighbours, copy_share)
    return [t for i, t in enumerate(lines) if i not in gone]


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
ORDER = ["host", "path", "url", "page_id"]


def _key(host: str, path: str, url: str | None, page_id: int | None) -> tuple:
    """Compares as Spark sorts: nulls first, strings by code point."""
    return host, path, url is not None, url or "", page_id is not None, page_id or 0


def _placer(lows: list[tuple], highs: list[tuple]):
    """The ranges a page goes to: its own, then those whose first or last page it adjoins."""

    def place(host: pa.Array, path: pa.Array, url: pa.Array, page_id: pa.Array) -> pa.Array:
        out = []
        for row in zip(host.to_pylist(), path.to_pylist(), url.to_pylist(), page_id.to_pylist()):
            key = _key(*row)
            own = bisect_right(lows, key) - 1
            parts = [own]
            if key == highs[own] and own + 1 < len(lows):
                parts.append(own + 1)
            if key == lows[own] and own:
                parts.append(own - 1)
            out.append(parts)
        return pa.array(out, pa.list_(pa.int32()))

    return place


def _extract(copy_share: float):
    """Texts of a range's own pages; pages of the adjoining ranges are neighbours only."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        current: tuple | None = None
        held: list[dict] = []

        def settle(after: tuple | None) -> None:
            page_id, url, host, _, own, lines, marked = current
            if own:
                near = [x[5] for x in (before, after) if x is not None and x[2] == host]
                text = "\n".join(lines if marked else differenced(lines, near, copy_share))
                held.append({"page_id": page_id, "url": url, "text": text})

        for batch in batches:
            rows = zip(*[batch.column(c) for c in ("page_id", "url", "host", "part", "own", "html")])
            for *place, html in rows:
                row = (*(c.as_py() for c in place), *blocks_of(html.as_py()))
                if current is not None:
                    same = row[3] == current[3]
                    settle(row if same else None)
                    before = current if same else None
                current = row
                if len(held) >= 500:
                    yield pa.RecordBatch.from_pylist(held, _TEXTS)
                    held.clear()
        if current is not None:
            settle(None)
        if held:
            yield pa.RecordBatch.from_pylist(held, _TEXTS)

    return texts


def _located(pages: DataFrame) -> DataFrame:
    """``pages`` with the host and path of the url."""
    url, pattern = F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"
    return pages.withColumns({
        "host": F.lower(F.regexp_extract(url, pattern, 1)), "path": F.regexp_extract(url, pattern, 2),
    })


def main_texts(pages: DataFrame, copy_share: float = COPY_SHARE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are those of the keys alone, so the pages are placed once and stored nowhere.
    ends = (
        _located(pages.select("page_id", "url")).repartitionByRange(n, *ORDER)
        .withColumn("part", F.spark_partition_id()).groupBy("part")
        .agg(F.min(F.struct(*ORDER)).alias("low"), F.max(F.struct(*ORDER)).alias("high"))
        .collect()
    )
    ends.sort(key=lambda r: _key(*r["low"]))
    place = F.arrow_udf(_placer([_key(*r["low"]) for r in ends], [_key(*r["high"]) for r in ends]), "array<int>")
    placed = _located(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "html", F.posexplode(place(*ORDER)).alias("copy", "part")
    )
    ranges = placed.select("page_id", "url", "html", "part", (F.col("copy") == 0).alias("own"))
    ranges = _located(ranges.repartitionById(max(1, len(ends)), "part")).sortWithinPartitions("part", *ORDER)
    return ranges.drop("path").mapInArrow(
        _extract(copy_share), "page_id long, url string, text string"
    ).withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages by differencing each page with the page of nearest URL.

Pages of a host are ordered by URL path, and each is paired with the page before it (a
host's first page with the one after it). Their text lines are aligned by longest common
subsequence; shared lines are taken for the site's furniture and deleted. Markup then checks
the outcome: a shared line that stands inside the page's article is the page's own text (copies
and quotations share it) and stays; a line inside an element that names itself as furniture is
none of the article even where no other page shows it, and so is, on a page with an article,
all that stands outside of it. Where shared lines hold more than two thirds of the characters
that markup leaves open, the nearest page is a copy or a quotation: they stay, furniture included.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.storage import materialise

PLAIN, ARTICLE, FURNITURE = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>", re.S
)
_NAMED = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_RAW = frozenset("script style textarea noscript iframe template svg xmp".split())
_FURNITURE_TAGS = frozenset("head nav footer aside form button select dialog menu label fieldset object".split()) | _RAW
_ARTICLE_TAGS = frozenset(["article", "main"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr label button".split()
)
# Words of class, id and role that mark furniture.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "notification nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead contentinfo complementary "
    "comment comments disqus respond related share sharing social newsletter subscribe subscription signup login popup "
    "modal dialog alert search widget".split()
)


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The page's blocks in order, white space made single and trimmed, and the role of each.

    A block ends where a block element or a line break does. Unclosed elements end with the
    element around them; a raw element without end takes the rest of the page.
    """
    lines, roles, parts = [], [], []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    at = 0

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(text)
            roles.append(stack[-1][1])

    while True:
        token = _TOKEN.search(page, at)
        parts.append(html.unescape(page[at : token.start() if token else len(page)]))
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if name not in _INLINE:
            flush()
        if token[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in ("p", "li") and stack[-1][0] == name:
            stack.pop()
        role = stack[-1][1]
        if role != FURNITURE and (name in _FURNITURE_TAGS or name == "header" and role != ARTICLE or _marked(token[3])):
            if name not in ("html", "body"):
                role = FURNITURE
        elif role == PLAIN and name in _ARTICLE_TAGS:
            role = ARTICLE
        if role != stack[-1][1] and name in _INLINE:
            flush()
        stack.append((name, role))
    flush()
    return lines, roles


def _marked(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key != "style" and not _FURNITURE_WORDS.isdisjoint(_WORD.findall(value)):
            return True
    return False


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence, by length
    links: list[tuple] = []  # its last pair, chained to the one before
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


_ORDER = ["host", "path", "url", "page_id", "version"]


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, version, shared): positions of the lines each page shares with its nearest page.

    Only hashes of lines are sorted. The order of all pages is cut into ranges, so a host
    with most of the pages is spread over many tasks; a range's first and last page, whose
    neighbours lie in other ranges, are paired afterwards (two rows for each range).
    """
    kind = dict(pages.dtypes)["page_id"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            address = [_address(u) for u in batch["url"]]
            hashes = [np.array([digest(x) for x in lines_of(h)[0]], dtype=np.uint64).view(np.int64) for h in batch["html"]]
            yield batch[["page_id", "url", "version"]].assign(host=[h for h, _ in address], path=[p for _, p in address], hashes=hashes)

    fields = f"page_id {kind}, url string, version long, host string, path string, hashes array<long>"
    slim = materialise(pages.select("page_id", "url", "html", "version").mapInPandas(hashed, fields), "page-lines")

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = waiting = None  # the row before; the row whose neighbour comes after it
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                near = before is not None and before.host == row.host
                if waiting is not None:
                    out.append(_pair(waiting[0], row if row.host == waiting[0].host else None, waiting[1], True))
                    waiting = None
                if near:
                    out.append(_pair(row, before, False, True))
                else:
                    waiting = (row, before is None)
                before = row
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = [_pair(waiting[0], None, True, False)] if waiting is not None else []
        if before is not None:
            out.append(_pair(before, None, None, False))  # the last row, for the next range's first one
        if out:
            yield pd.DataFrame(out, columns=columns)

    def _pair(row, other, first: bool | None, known_next: bool) -> tuple:
        """first: the range's first row (its neighbour may lie in the range before); None: a copy of the last row."""
        shared = common_lines(row.hashes.tolist(), other.hashes.tolist()) if other is not None else []
        edge = first is None or first or not known_next
        kept = (row.host, row.path, row.url, row.hashes) if edge else (None, None, None, None)
        return (row.page_id, row.version, shared, edge, first is None, known_next, *kept)

    columns = ["page_id", "version", "shared", "edge", "copy", "known_next", "host", "path", "url", "hashes"]
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = slim.repartitionByRange(spread, *_ORDER).sortWithinPartitions(*_ORDER)
    schema = (
        f"page_id {kind}, version long, shared array<int>, edge boolean, copy boolean, known_next boolean, "
        "host string, path string, url string, hashes array<long>"
    )
    first = materialise(ranges.mapInPandas(paired, schema), "page-pairs")

    # Edges in order, each range's copy of its last row after its first row.
    edges = first.where("edge").orderBy(*[F.asc_nulls_first(c) for c in _ORDER], "copy").collect()
    settled = []
    for k, row in enumerate(edges):
        if row.copy:
            continue
        other = edges[k - 1] if k and edges[k - 1].copy and edges[k - 1].host == row.host else None
        if other is None and not row.known_next:
            after = [e for e in edges[k + 1 : k + 3] if not e.copy]
            other = after[0] if after and after[0].host == row.host else None
        shared = common_lines(row.hashes, other.hashes) if other is not None else row.shared
        settled.append((row.page_id, row.version, shared))
    fields = f"page_id {kind}, version long, shared array<int>"
    settled = pages.sparkSession.createDataFrame(settled, fields)
    return first.where("NOT edge").select("page_id", "version", "shared").unionByName(settled)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_shared) per row of ``pages``.

    A null page is empty; a page without text gives an empty one. A null or broken URL counts
    as a host of its own without path. Repeated rows are pages of their own and share all
    their lines. Other columns are ignored.
    """
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("version", F.xxhash64("url", "html"))
    shared = shared_lines(rows).dropDuplicates(["page_id", "version"])

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lines_of(h) for h in batch["html"]]
            yield batch[["page_id", "url", "version"]].assign(lines=[a for a, _ in found], roles=[b for _, b in found])

    fields = f"page_id {kind}, url string, version long, lines array<string>, roles array<int>"
    lines = rows.mapInPandas(parsed, fields)
    same = lines.page_id.eqNullSafe(shared.page_id) & (lines.version == shared.version)
    role = "get(roles, i)"
    plain = f"filter(lines, (line, i) -> {role} = {PLAIN}"
    copied = f"3 * length(array_join({plain} AND NOT array_contains(shared, i)), '')) < length(array_join({plain}), ''))"
    kept = f"""filter(lines, (line, i) -> {role} <> {FURNITURE}
        AND ({role} = {ARTICLE} OR NOT array_contains(roles, {ARTICLE}) AND (copied OR NOT array_contains(shared, i))))"""
    return lines.join(shared, same, "left").withColumn("copied", F.expr(copied)).select(
        lines.page_id,
        lines.url,
        F.array_join(F.expr(kept), "\n").alias("text"),
        F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"),
    )


def op7(spark, folder: str) -> DataFrame:
    found = main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")

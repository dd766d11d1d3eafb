"""Main text of web pages, by role of elements and by differencing with the page of nearest URL.

Pages of a host are sorted by URL path. Of the pages next to it in this order that are not its copies, each is compared with the one
whose path has more in common with its own: their unmarked lines are aligned by a longest common
subsequence, and lines both have are template and go. Lines in a marked article are kept even if the neighbour has them, since
copies of an article share every line; an article that holds at least half of what is left is taken alone, and a smaller one (a teaser) in
place among the lines around it. Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by element, class, id or role, on elements of any kind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

# Element names and class words, by role.
DROPPED = frozenset("nav footer aside form head noscript template iframe object svg canvas select button dialog menu audio video map".split())
MAIN = frozenset("article main".split())
OPEN = frozenset("html body div section header ul ol table tbody thead tr td th dl figure details fieldset center".split()) | DROPPED | MAIN
BLOCKS = OPEN | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption summary caption title".split())
ROLES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert
popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments
respond disqus share sharing social related widget toolbar login search""".split())
COMMENTS = frozenset("comment comments respond disqus".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = frozenset("li dt dd".split())
TITLED = frozenset("a h1 h2 h3 h4 h5 h6 dt".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_SPACE = re.compile(r"\s+")
RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _roles(attributes: str, inner: bool, titled: bool) -> set[str]:
    """Words of class, id and role.

    Of paragraphs, list items and inline elements (``inner``) only whole names count, and the ids of headings and anchors
    (``titled``) not at all, since these are made from the text.
    """
    found = [(x[0].lower(), "".join(x[1:]).lower()) for x in _NAMED.findall(attributes)]
    values = " ".join(v for k, v in found if not (titled and k == "id"))
    return set(values.split() if inner else re.split(r"[^a-z]+", values))


def lines(page: str) -> list[tuple[bool, str]]:
    """(whether in a marked article, line) of all lines that no role rules out, in page order."""
    out: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    dropped = marked = 0

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                out.append((marked > 0, line))
            text.clear()

    def close(to: int) -> None:
        nonlocal dropped, marked
        for _, drop, main in stack[to:]:
            dropped, marked = dropped - drop, marked - main
        del stack[to:]

    def inner() -> int:
        """Where the entries above the last sectioning element begin."""
        return next((i + 1 for i in range(len(stack) - 1, -1, -1) if stack[i][0] in OPEN), 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            text.append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = m[3].lower() if m[3] else None
        if name is None:
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCKS:
            flush()
        if m[2]:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if to is not None and (name in OPEN or to >= inner()):
                close(to)
            elif to is None and name in BLOCKS and name not in OPEN:
                # The end of a block that needed no entry ends the inline elements left open in it.
                close(next((i for i in range(inner(), len(stack)) if stack[i][0] not in BLOCKS), len(stack)))
            continue
        if name in BLOCKS and stack:
            # A block ends an open paragraph, an item the item before it.
            close(next((i for i in range(inner(), len(stack)) if stack[i][0] == "p" or name in ITEMS and stack[i][0] in ITEMS), len(stack)))
        if name in VOID or m[4].endswith("/"):
            continue
        main = name in MAIN
        drop = name in DROPPED or name == "header" and not marked
        if m[4] and name not in ("html", "body"):
            drop = drop or bool(_roles(m[4], name not in OPEN, name in TITLED) & (COMMENTS if main else ROLES)) or bool(_HIDDEN.search(m[4]))
        if drop or name in OPEN or any(s[0] == name for s in stack):
            stack.append((name, drop, main))
            dropped, marked = dropped + drop, marked + main
    if at < len(page) and not dropped:
        text.append(html.unescape(page[at:]))
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of the two lists.

    Equal ends are cut off first; between them the table is kept a row at a time (Hirschberg), so space is linear.
    """
    out: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.add(j - 1)
            j, m = j - 1, m - 1
        shared = set(a[i:j]) & set(b[k:m])
        if not shared:
            continue
        if j - i == 1:
            out.add(i)
            continue
        mid = (i + j) // 2
        up, down = _row(a[i:mid], b[k:m]), _row(a[mid:j][::-1], b[k:m][::-1])[::-1]
        best = max(range(m - k + 1), key=lambda x: up[x] + down[x])
        work += [(i, mid, k, k + best), (mid, j, k + best, m)]
    return out


def _row(a: list[str], b: list[str]) -> list[int]:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for n, y in enumerate(b, 1):
            before, row[n] = row[n], before + 1 if x == y else max(row[n], row[n - 1])
    return row


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def unmarked(page: tuple) -> list[str]:
    return [line for inside, line in page[2] if not inside]


def main_text(page: tuple, before: tuple | None, after: tuple | None) -> str:
    """Text of a page (host, path, lines), given the nearest pages in URL order that are not its copies."""
    left = [line for _, line in page[2]]
    outside = [i for i, (inside, _) in enumerate(page[2]) if not inside]
    near = [x for x in (before, after) if x is not None and x[0] == page[0]]
    if outside and near:
        other = max(near, key=lambda x: _alike(x[1], page[1]))
        gone = common([left[i] for i in outside], unmarked(other))
        outside = [at for i, at in enumerate(outside) if i not in gone]
    article = [line for inside, line in page[2] if inside]
    if article and sum(map(len, article)) >= sum(len(left[i]) for i in outside):
        return "\n\n".join(article)
    keep = set(outside)
    return "\n\n".join(line for i, (inside, line) in enumerate(page[2]) if inside or i in keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come in URL order. A run of copies (same host, same lines) is held as its lines once and an id, URL and path a page."""
    before = lines_held = None
    run: list[tuple] = []
    rows: list[tuple] = []

    def settle(after: tuple | None) -> int:
        texts: dict[tuple, str] = {}
        for page_id, url, host, path in run:
            sides = [x is not None and x[0] == host and _alike(x[1], path) for x in (before, after)]
            nearer = (sides[0] is not False, sides[1] is not False, sides[0] >= sides[1])
            if nearer not in texts:
                texts[nearer] = main_text((host, path, lines_held), before, after)
            rows.append((page_id, url, texts[nearer], len(texts[nearer])))
        return sum(r[3] for r in rows)

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "text", "n_chars"])
        rows.clear()
        return out

    for batch in batches:
        for page_id, url, host, path, raw in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "html"))):
            host, path, found = host or "", path or "", lines(raw or "")
            if run and (run[-1][2] != host or lines_held != found):
                if settle((host, path, found)) > 4 << 20:
                    yield batch_of()
                before, run = (*run[-1][2:], lines_held), []
            run.append((page_id, url, host, path))
            lines_held = found
        if rows:
            yield batch_of()
    if run:
        settle(None)
        yield batch_of()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Input: page_id, url, html (other columns are ignored). Null or empty html gives an empty text; null urls are one host.
    Blocks are joined by two line feeds; white space in a block becomes one space. Pages are dealt by ranges of (host, path, page_id), so
    a host of any size spreads over tasks, and stream through them with one page before, one after and the ids of a run of copies in
    memory. Copies are no neighbours of each other. Of two neighbours equally near the earlier is taken. The first and last
    page of a range have one neighbour, which can change texts only where lines outside an article are left.
    """
    ship(pages.sparkSession)
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    rows = pages.select(F.col("page_id").cast("bigint"), url, host.alias("host"), path.alias("path"), "html")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return ordered.mapInArrow(_extract, RESULT)

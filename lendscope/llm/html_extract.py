"""Main text of web pages: structure first, then differencing against the page with the nearest URL.

A page is read into text blocks, each in the article, in page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments: by element, role, class or id) or loose. Pages of a host stand in the order of their URL
paths. Pages in a row with equal blocks are copies and stand there once; each is aligned with its neighbours, the nearest
different pages, by the longest common subsequence of block hashes. Blocks shared with a neighbour are the host's
template. Furniture always goes. Where the page marks its article, the article's blocks are the text; shared blocks stay
there, since articles quote and copy each other. Where nothing marks it, the loose blocks that no neighbour shares are
the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import forget, running_totals, stage

ARTICLE, LOOSE, FURNITURE, TEASER = 0, 1, 2, 3

#: Elements whose content is never text; elements of page furniture; block and void elements.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class and id names that mark page furniture anywhere, and those that do so outside an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social related recommended "
    "recommendations widget toolbar login search pagination pager skip".split())
OUTER_NAMES = frozenset("header masthead footer topbar top bottom copyright legal alert announcement".split())
REMARKS = frozenset("comment comments disqus reply replies".split())
ABOUT = frozenset("no has with without is not".split())
#: Inside an article only container elements are furniture by name, and only if every part of the class or id
#: is such a name or one of these ("share-buttons", "related-posts"; not "share-price").
CONTAINERS = frozenset("div section aside ul ol dl table figure nav span header footer details".split())
PLAIN_PARTS = frozenset(
    "area article articles bar block bottom box button buttons container content form icons inline item items left links list "
    "module newsletter panel post posts right row section side slot small stories story text top unit wrap wrapper".split())
#: Names of articles that only announce others; they are text on pages that have no other article.
TEASERS = frozenset("teaser teasers card preview related recommended recommendation promo".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[a-z0-9]+")


def _names(attributes: str) -> tuple[set[str], set[str], bool, str]:
    """Words of class and id, the words that these names begin with, whether one is furniture throughout, and the role.

    "no-ads" and the like name nothing.
    """
    words: set[str] = set()
    heads: set[str] = set()
    role, whole = "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = _NAME.findall(token)
                if parts and parts[0] not in ABOUT:
                    words.update(parts)
                    heads.add(parts[0])
                    whole |= any(x in NAMES for x in parts) and all(x in NAMES or x in PLAIN_PARTS or x.isdigit() for x in parts)
        elif name == "role":
            role = value.strip()
    return words, heads, whole, role


def blocks(html: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with its zone; character references decoded, white space single."""
    html = html or ""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it is furniture, an article, one that only announces
    text: list[str] = []

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            # A form around the article is part of the page's frame: it does not make the article furniture.
            core = max((k for k, x in enumerate(stack) if x[0] in ("article", "main")), default=-1)
            furniture = any(x[1] and (k > core or x[0] != "form") for k, x in enumerate(stack))
            zone = FURNITURE if furniture else TEASER if any(x[3] for x in stack) else ARTICLE if any(x[2] for x in stack) else LOOSE
            out.append((line, zone, any(x[0] == "main" for x in stack)))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    at = 0
    while True:
        found = _TOKEN.search(html, at)
        if found is None:
            text.append(unescape(html[at:]))
            break
        if found.start() > at:
            text.append(unescape(html[at:found.start()]))
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] if found[2] else found[6]
        if name == "br":
            text.append(" ")
            continue
        if closing:
            if name in BLOCKS:
                flush()
            close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p" or name in ("li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                stack.pop()
        if name in VOID or attributes.endswith("/"):
            continue
        words, heads, whole, role = _names(attributes) if attributes else (set(), set(), False, "")
        article = any(x[2] for x in stack)
        if name in ("article", "main"):
            # an article does not stand in a menu or header: such an element was not closed
            for k, x in enumerate(stack):
                if x[0] in ("head", "nav", "header"):
                    del stack[k:]
                    break
            furniture = bool(heads & REMARKS)
        elif name in ("html", "body"):
            furniture = False
        else:
            furniture = (name in DROPPED or role in ROLES or (whole and name in CONTAINERS if article else bool(words & NAMES))
                         or not article and (name == "header" or bool(words & OUTER_NAMES)))
        stack.append((name, furniture, name == "article" and not furniture, name == "article" and bool(heads & TEASERS)))
    flush()
    if any(zone == TEASER for _, zone, _ in out):
        other = any(zone == ARTICLE for _, zone, _ in out)
        out = [(line, (FURNITURE if other else ARTICLE) if zone == TEASER else zone, m) for line, zone, m in out]
    marked = any(zone == ARTICLE for _, zone, _ in out)
    main = not marked and any(m and zone == LOOSE for _, zone, m in out)
    return [(line, ARTICLE if main and m and zone == LOOSE else zone) for line, zone, m in out]


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which items of ``a`` are in a longest common subsequence with ``b``.

    Rows of the table are bits of one number each. Only every r-th row is kept, r being the root of their number; the rows
    between are made again, stretch by stretch, on the way back. So long pages take (length of b) / 8 bytes for about
    twice the root of the length of a.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def following(v: int, items: list[int]) -> Iterator[int]:
        for x in items:
            u = v & where.get(x, 0)
            v = ((v + u) | (v - u)) & full
            yield v

    step = math.isqrt(len(a)) + 1
    kept = [full, *(v for k, v in enumerate(following(full, a), 1) if k % step == 0)]
    out = [False] * len(a)
    i, j = len(a), len(b)
    length = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step], *following(kept[first // step], a[first:i])]
        while i > first and j:
            here = length(rows[i - first], j)
            if length(rows[i - first - 1], j) == here:
                i -= 1
            elif length(rows[i - first], j - 1) == here:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out[i] = True
    return out


def main_text(html: str | None, template: set[int]) -> str:
    """The page's text; ``template`` has the numbers of the blocks that are shared with a neighbour."""
    found = blocks(html)
    marked = any(zone == ARTICLE for _, zone in found)
    return "\n".join(line for k, (line, zone) in enumerate(found)
                     if (zone == ARTICLE if marked else zone == LOOSE and k not in template))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in blocks(html.as_py())] for html in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(lines, pa.list_(pa.int64()))],
                                         ["id", "host", "path", "mark", "lines"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        template = []
        for lines, *others in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            template.append(sorted({k for other in others if other for k, x in enumerate(shared_lines(lines, other)) if x}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(template, pa.list_(pa.int32())), pa.array(list(map(len, template)), pa.int64())],
            ["run", "template", "n_shared"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), set(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(4)],
            ["id", "url", "text", "n_chars", "n_shared"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?(.*)$", 1)


def extract_pages(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars, n_shared (blocks that a neighbour shares).

    NULL html counts as empty and gives an empty text; a NULL or relative URL belongs to the empty host. Pages with
    equal paths follow their id, then their content; repeated rows are one page for the pairing. Pages in a row on one
    host with equal blocks are one run: its first page meets the runs before and after, and its verdict is that of all.
    A run alone on its host has no neighbour. Hosts are not kept together: pages are ordered over the whole table, so a
    host with a third of all pages is spread like any other. Other columns are ignored.
    """
    mark = F.xxhash64(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.coalesce(F.col(f"`{html}`"), F.lit("")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), mark.alias("mark"))
    described = stage(rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html", "mark").mapInArrow(
        _described, "id long, host string, path string, mark long, lines array<long>").dropDuplicates(["id", "mark"])
        .withColumn("blocks", F.xxhash64("lines")), "pages-lines")
    # the order needs the addresses alone; lines join the first pages of the runs
    numbered = running_totals(described.select("host", "path", "id", "mark", "blocks", F.lit(1).cast("long").alias("one")),
                              ["host", "path", "id", "mark"], {"place": "one"}, "pages-order")
    placed = stage(numbered.select("place", F.xxhash64("host").alias("host"), "id", "mark", "blocks"), "pages-placed")
    forget(numbered)
    last = placed.select((F.col("place") + 1).alias("place"), F.col("host").alias("last_host"), F.col("blocks").alias("last_blocks"))
    opens = F.when((F.col("host") == F.col("last_host")) & (F.col("blocks") == F.col("last_blocks")), 0).otherwise(1).cast("long")
    steps = running_totals(placed.join(last, "place", "left").select("place", "host", F.col("id").alias("vid"), F.col("mark").alias("vmark"), opens.alias("opens")),
                           ["place"], {"run": "opens"}, "pages-steps")
    runs = stage(steps.drop("place"), "pages-runs")
    forget(steps)
    forget(placed)
    own = F.col("id").eqNullSafe(F.col("vid")) & (F.col("mark") == F.col("vmark"))
    firsts = stage(described.select("id", "mark", "lines").join(runs.where("opens = 1"), own).select("run", "host", "lines"), "pages-firsts")
    forget(described)
    beside = lambda step, name: firsts.select(
        (F.col("run") + step).alias("run"), F.col("host").alias(f"h{name}"), F.col("lines").alias(name))
    pairs = firsts.join(beside(1, "before"), "run", "left").join(beside(-1, "behind"), "run", "left")
    of_host = lambda name: F.when(F.col("host") == F.col(f"h{name}"), F.col(name)).alias(name)
    verdict = pairs.select("run", "lines", of_host("before"), of_host("behind")).mapInArrow(
        _compared, "run long, template array<int>, n_shared long")
    verdict = runs.select("vid", "vmark", "run").join(verdict, "run").drop("run")
    same = F.col("id").eqNullSafe(F.col("vid")) & (F.col("mark") == F.col("vmark"))
    out = rows.join(verdict, same, "left").select("id", "url", "html", "template", "n_shared").mapInArrow(
        _extracted, "id long, url string, text string, n_chars long, n_shared long")
    return out.withColumnsRenamed({"id": id_col, "url": url})

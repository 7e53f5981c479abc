"""Main text of web pages by nearest-address page differencing.

1. A page is read into blocks (paragraphs, headings, list entries, cells ...),
   each a line of text with white space as single blanks and references decoded.
   A line knows whether it lies in content that the page declares (``article``,
   ``main`` and the like) or in boilerplate (menus, headers, footers, sidebars,
   notices, adverts, forms, comments, by element, role, class or id). A class or
   id counts if all its parts are names of boilerplate or of boxes (``share-box``,
   not ``has-sidebar``), or one part tells of comments or adverts and none denies
   it (``user-comments``, ``js-ad``, not ``with-comments``), and not for an element around declared content (apart
   from comments and links to other pages, where every card may be an ``article``)
   nor around most of the text of a page that declares none outside it.
2. Pages of a host are ordered by the path of their address; a page is paired
   with the nearest page before or after it that isn't a copy, of the two the one
   that shares more of its path with it. A copy, which tells nothing, has the same
   lines, or most of them by number and by length; boilerplate and template lines
   of the host (4.) don't count. Where all pages of the range are copies, up to
   eight others of the host, drawn by hash, are tried instead.
3. The lines of the two pages are aligned by longest common subsequence, and
   the shared lines are deleted: templates repeat, articles don't.
4. Lines that more than half of a host's differing pages carry, and three at
   least, are template as well, wherever they stand.
5. What a page declares as content is an exception, as two articles may well
   share a paragraph, and all pages of a host a line: its lines stay unless they
   are template by (4.) and some page of the host has them outside its declared
   content. Where such lines make up most of the declared content, the pages are
   versions of one text and it stays whole. Text outside the declared element is
   kept like that of any page. Boilerplate lines go in any case.
6. A page without a page to compare it with is judged block by block: outside
   declared content, lines go that are mostly links, short lines with the words of
   notices (cookies, terms, copyright ...), and, behind declared content that makes
   up most of the page, lines that hold no sentence.

A first pass counts per host how many differing pages carry a line. The order by
host and path is cut into ranges of about equal counts. A range also gets the
last page of the range before it, the first of the one after, and of its hosts the
template lines and, if they reach over several ranges, the pages drawn by hash. So
a busy host is spread over tasks; a task holds the lines of one host's pages in
its range.

Defined cases: a null page has an empty text, a null address is an empty one (a
host and path of their own); on a host of two pages, lines that make up most of
both by number and by length make them copies, template or not; pages of one address follow each other by id, a
null id first; repeated rows are pages each; a page without a neighbour on its
host, or with copies only, is judged by itself (6.); extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.frames import column, released, text_of, written

_WORDS = frozenset("""nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner
    cookie cookies consent gdpr notice notices alert popup modal overlay promo promotion sponsor sponsored share sharing social
    comment comments reply replies disqus related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe
    subscription widget toolbar login signin signup search""".split())
#: Elements that are never content, and those whose inside is not markup.
BOILERPLATE = frozenset("""head title nav footer aside form script style noscript template iframe button select option textarea svg math
    canvas object embed audio video dialog menu datalist input label fieldset legend""".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead
    title tr ul""".split())
#: An open element that the start of another one ends.
CLOSED_BY_BLOCK = frozenset({"p"})
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts that may stand beside those words in a class or id, as in ``share-box`` or ``site-header``.
_BESIDE = frozenset("""bar block bottom box btn button buttons container content fixed global group inner item items left link links list main
    mobile outer panel post primary right row secondary section site slot sticky sub text title top unit wrap wrapper""".split())
#: Boilerplate of the page, but the title's place inside an article and beside these parts.
_TOPS, _OF_TEXT = frozenset("header masthead banner".split()), frozenset("content group item post section text title".split())
#: Boilerplate whose entries may be articles of their own.
_CARDS = frozenset("ad ads comment comments reply replies disqus related recommended promo promotion sponsor sponsored".split())
#: Words of a class or id that tell by themselves, and those that deny them.
_TELLING = frozenset("ad ads advert adverts advertisement advertising comment comments disqus sponsored".split())
_DENYING = frozenset("no non not has have with without hide hidden enable enabled disable disabled allow before after count".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+(?:x[0-9]+)?")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Of two pages with at least this share of equal lines, one is a copy of the other.
COPY_SHARE = 0.8
#: A line of the host's template is on more than half of its differing pages, and on so many at least.
TEMPLATE_PAGES = 3
#: Words of notices, and up to how many words a line with one of them is a notice.
_NOTICE = re.compile(r"(?i)\b(?:cookies?|consent|gdpr|privacy|terms|imprint|copyright|all rights reserved|newsletter|subscribe|sign (?:in|up)|log ?in|skip to)\b|©")
NOTICE_WORDS = 25
_SENTENCE = re.compile(r"[.!?…:][\"'”’)]*$")
#: Hosts whose number of pages goes along to every task; beyond, a join shuffles.
BROADCAST_HOSTS = 200_000

CONTENT, PLAIN, CHROME = 2, 1, 0
#: The columns of a page on its way to a range.
PAGE = ("page_id", "url", "host", "path", "rank", "lines")


@dataclass(frozen=True)
class Line:
    text: str
    zone: int
    linked: bool = False


@dataclass(frozen=True)
class Host:
    """The numbers of the lines that a host repeats: those to delete from plain text, and from declared content too."""

    plain: frozenset[int] = frozenset()
    declared: frozenset[int] = frozenset()


@lru_cache(10_000)
def _hint(names: str) -> frozenset[str]:
    """The boilerplate words of a class or id that has no other parts than those and names of boxes."""
    found: set[str] = set()
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if _TELLING.intersection(parts) and not _DENYING.intersection(parts):
            found |= _TELLING.intersection(parts)
        elif all(p in _WORDS or p in _BESIDE or p[0].isdigit() for p in parts):
            words = _WORDS.intersection(parts)
            found |= words - _TOPS if _OF_TEXT.intersection(parts) else words
    return frozenset(found)


def _zone(tag: str, attributes: str, inside: int) -> tuple[int, frozenset[str]]:
    """The zone inside an element, given the zone around it, and the boilerplate words of its class and id."""
    if inside == CHROME or tag in BOILERPLATE or tag == "header" and inside != CONTENT:
        return CHROME, frozenset()
    words: frozenset[str] = frozenset()
    if attributes.strip():
        found = {n.lower(): html.unescape(a or b or c or "") for n, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        if (role in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
                or "display:none" in found.get("style", "").replace(" ", "").lower()):
            return CHROME, words
        if tag not in ("html", "body", "article", "main", "h1"):
            words = _hint(found.get("class", "")) | _hint(found.get("id", ""))
            words = words - _TOPS if inside == CONTENT else words
        if role in ("main", "article") or found.get("itemprop") == "articleBody":
            return CONTENT, words
    return CONTENT if tag in ("article", "main") else inside, words


@dataclass
class _Hinted:
    """An element whose class or id tells of boilerplate, within ``around`` others; whether it holds content declared in it."""

    cards: bool
    around: _Hinted | None
    declares: bool = False
    size: int = 0
    content: int = 0

    def outer(self) -> Iterator[_Hinted]:
        at: _Hinted | None = self
        while at:
            yield at
            at = at.around


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order."""
    out: list[tuple[Line, _Hinted | None]] = []
    open_: list[tuple[str, int, _Hinted | None]] = []
    pieces: list[str] = []
    zone, hinted, linked = PLAIN, None, 0

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        pieces.append(text)
        if any(tag == "a" for tag, _, _ in open_):
            linked += len("".join(text.split()))

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append((Line(text, zone, 2 * linked > len(text.replace(" ", ""))), hinted))
        linked = 0

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at: token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in BLOCKS:
                end_line()
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if depth is not None:
                del open_[depth:]
        else:
            if tag in BLOCKS:
                end_line()
                if open_ and open_[-1][0] in CLOSED_BY_BLOCK:
                    open_.pop()
                # a paragraph also ends when only text styling is open inside it
                inner = len(open_)
                while inner and open_[inner - 1][0] not in BLOCKS:
                    inner -= 1
                if inner and open_[inner - 1][0] in CLOSED_BY_BLOCK:
                    del open_[inner - 1:]
                if open_ and open_[-1][0] in SIBLINGS.get(tag, ()):
                    open_.pop()
            elif tag == "br":
                pieces.append(" ")
            around, outer = open_[-1][1:] if open_ else (PLAIN, None)
            if tag in RAW and not token[3].rstrip().endswith("/"):
                close = re.compile(r"</" + re.escape(tag) + r"\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif tag not in VOID:
                inner_zone, words = _zone(tag, token[3], around)
                if inner_zone == CONTENT and around == PLAIN:
                    for scope in outer.outer() if outer else ():
                        scope.declares |= not scope.cards
                if words:
                    outer = _Hinted(bool(words & _CARDS), outer)
                open_.append((tag, inner_zone, outer))
        now, scope = open_[-1][1:] if open_ else (PLAIN, None)
        if now != zone or scope is not hinted:
            end_line()
            zone, hinted = now, scope
    end_line()
    return _settled(out)


def _settled(found: list[tuple[Line, _Hinted | None]]) -> list[Line]:
    """The lines, with those inside hinted elements as boilerplate unless the element holds the content of the page."""
    size = content = 0
    for line, hinted in found:
        if line.zone != CHROME:
            size += len(line.text)
            content += line.zone == CONTENT
            for scope in hinted.outer() if hinted else ():
                scope.size += len(line.text)
                scope.content += line.zone == CONTENT

    def boilerplate(scope: _Hinted) -> bool:
        return not scope.declares and (2 * scope.size <= size or content > scope.content)

    return [
        Line(line.text, CHROME, line.linked) if hinted and any(boilerplate(s) for s in hinted.outer()) else line
        for line, hinted in found
    ]


def common_lines(mine: list[str], other: list[str]) -> set[int]:
    """The places in ``mine`` of a longest common subsequence of the two lists.

    Rows of the alignment are bit sets (a cleared bit: the subsequence grows at
    this place); a few are kept and those between are worked out again on the
    way back, so memory grows with the root of the longer list.
    """
    places: dict[str, int] = {}
    for i, line in enumerate(mine):
        places[line] = places.get(line, 0) | (1 << i)
    full = (1 << len(mine)) - 1
    step = max(1, math.isqrt(len(other)))

    def rows(first: int, row: int) -> list[int]:
        made = [row]
        for line in other[first: first + step]:
            both = row & places.get(line, 0)
            row = ((row + both) | (row - both)) & full
            made.append(row)
        return made

    kept = [full]
    for first in range(0, len(other), step):
        kept.append(rows(first, kept[-1])[-1])
    out: set[int] = set()
    i, j, block, held = len(other), len(mine), -1, []
    while i and j:
        if (i - 1) // step != block:
            block = (i - 1) // step
            held = rows(block * step, kept[block])
        if mine[j - 1] == other[i - 1]:
            out.add(j - 1)
            i, j = i - 1, j - 1
        elif held[i - block * step] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def shared_path(one: str, other: str) -> int:
    """How many leading characters two paths have in common."""
    return next((i for i, (a, b) in enumerate(zip(one, other)) if a != b), min(len(one), len(other)))


def numbers(lines: Sequence[Line]) -> list[int]:
    """A number for the text of each line."""
    return [int.from_bytes(blake2b(line.text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for line in lines]


def shared_lines(lines: list[Line], mine: list[int], other: list[int], host: Host) -> set[int] | None:
    """The places of the lines that another page has as well; None if the two are copies."""
    if mine == other:
        return None
    at = [i for i, number in enumerate(mine) if number not in host.plain]
    common = [at[i] for i in common_lines([mine[i] for i in at], other)]
    if len(common) >= COPY_SHARE * len(at) and sum(len(lines[i].text) for i in common) >= COPY_SHARE * sum(len(lines[i].text) for i in at):
        return None
    return set(common)


def nearest(held: list[tuple[list[Line], list[int]]], host: Host, step: int) -> list[tuple[int, set[int]] | None]:
    """For each page the nearest one before (``step`` -1) or after it (1) that isn't a copy, and the lines that it has as well.

    From a copy the search goes on to the page that is none of the copy's copies, so long runs take few steps.
    """
    out: list[tuple[int, set[int]] | None] = [None] * len(held)
    for i in range(len(held)) if step < 0 else range(len(held) - 1, -1, -1):
        at = i + step
        while 0 <= at < len(held):
            common = shared_lines(*held[i], held[at][1], host)
            if common is not None:
                out[i] = at, common
                break
            at = out[at][0] if out[at] else -1
    return out


def kept(lines: list[Line], mine: list[int], gone: set[int], host: Host) -> str:
    """The text without the lines at ``gone`` and without the template of the host."""
    declared = [(line.text, number in host.declared) for line, number in zip(lines, mine) if line.zone == CONTENT]
    repeated = [text for text, on_host in declared if on_host]
    whole = (len(repeated) >= COPY_SHARE * len(declared)
             and sum(map(len, repeated)) >= COPY_SHARE * sum(len(text) for text, _ in declared))
    return "\n".join(
        line.text for i, (line, number) in enumerate(zip(lines, mine))
        if (whole or number not in host.declared if line.zone == CONTENT else i not in gone and number not in host.plain))


def alone(lines: list[Line], host: Host) -> str:
    """The text of a page that has no other one to compare it with."""
    last = max((i for i, line in enumerate(lines) if line.zone == CONTENT), default=len(lines))
    declared = sum(len(line.text) for line in lines if line.zone == CONTENT)
    most = 2 * declared > sum(len(line.text) for line in lines)
    gone = {
        i for i, line in enumerate(lines) if line.zone == PLAIN and (
            line.linked or len(line.text.split()) <= NOTICE_WORDS and _NOTICE.search(line.text)
            or most and i > last and not _SENTENCE.search(line.text))}
    return kept(lines, numbers(lines), gone, host)


def main_text(lines: list[Line], path: str, neighbours: list[tuple[str, list[Line]]], host: Host = Host()) -> str:
    """The text of a page, given pages of its host, nearest first among those with equally much of the path."""
    lines = own(lines)
    mine = numbers(lines)
    for _, other in sorted(neighbours, key=lambda n: -shared_path(path, n[0])):
        gone = shared_lines(lines, mine, numbers(own(other)), host)
        if gone is not None:
            return kept(lines, mine, gone, host)
    return alone(lines, host)


def own(lines: list[Line]) -> list[Line]:
    return [line for line in lines if line.zone != CHROME]


def packed(page: str) -> str:
    """The lines of a page that aren't boilerplate as one text, each behind its zone (a digit, 4 more for a line of links)."""
    return "\n".join(f"{line.zone + 4 * line.linked}{line.text}" for line in own(lines_of(page)))


def unpacked(text: str) -> list[Line]:
    return [Line(line[1:], int(line[0]) % 4, int(line[0]) >= 4) for line in text.split("\n")] if text else []


def host_rows(pages: DataFrame, spread: Broadcast[frozenset[str]]) -> DataFrame:
    """``host`` with the numbers of the lines that it repeats, or for hosts in ``spread`` the lines of some ``others``, from ``host`` and ``html``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = [own(lines_of(page)) for page in batch.column("html").to_pylist()]
            found = [numbers(lines) for lines in pages_]
            outside = [sorted({n for n, line in zip(x, lines) if line.zone != CONTENT}) for x, lines in zip(found, pages_)]
            signs = [int.from_bytes(blake2b(repr(x).encode(), digest_size=8).digest(), "big", signed=True) for x in found]
            wide = [name in spread.value for name in batch.column("host").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(wide, type=pa.bool_()), pa.array(signs, type=pa.int64()),
                 *(pa.array(x, type=pa.list_(pa.int64())) for x in (found, outside))], ["host", "wide", "sign", "lines", "outside"])

    found = pages.select("host", "html").mapInArrow(released(counted), "host string, wide boolean, sign long, lines array<long>, outside array<long>")
    # pages of equal lines may differ in what they declare
    pages_ = written(found.filter("size(lines) > 0").withColumn("declares", F.xxhash64("outside")).dropDuplicates(["host", "sign", "declares"]), "differing-pages")
    differing = pages_.dropDuplicates(["host", "sign"])
    hosts = differing.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= TEMPLATE_PAGES)
    carried = differing.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n")).filter(F.col("n") >= TEMPLATE_PAGES)
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    # at most twice as many lines a host as a page of it has on average
    often = carried.join(hosts, "host").filter(2 * F.col("n") > F.col("pages"))
    outside = pages_.select("host", F.explode("outside").alias("line")).distinct().withColumn("out", F.lit(True))
    repeated = often.join(outside, ["host", "line"], "left").groupBy("host").agg(
        F.collect_list("line").alias("plain"), F.collect_list(F.when(F.col("out"), F.col("line"))).alias("declared"))
    drawn = [by("lines", F.xxhash64("sign", F.lit(seed))) for seed in range(4) for by in (F.min_by, F.max_by)]
    others = differing.filter("wide").groupBy("host").agg(F.array_distinct(F.array(*drawn)).alias("others"))
    return repeated.unionByName(others, allowMissingColumns=True)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", range_pages: int = 500) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page."""
    url = text_of(url_column)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    id_ = column(id_column).cast("long")
    # text order of a number with its sign: null first
    rank = F.coalesce(F.format_string("%020d", id_ + 2**62), F.lit(""))
    key = F.struct(host.alias("host"), path.alias("path"), rank.alias("rank"))
    keys = pages.select(key.alias("key"))
    ranges = max(1, min(100_000, -(-pages.count() // range_pages)))
    edges = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("range")).agg(
        F.min("key").alias("first"), F.max("key").alias("last")).select("first.*", F.col("last").alias("last")).collect()  # one row a range
    bounds = sorted(((r["host"], r["path"], r["rank"]), tuple(r["last"])) for r in edges)
    shared = pages.sparkSession.sparkContext.broadcast(([b[0] for b in bounds], [b[1] for b in bounds]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = shared.value
        for batch in batches:
            cells = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            cells["lines"] = [packed(page) for page in cells.pop("html")]
            keys = list(zip(cells["host"], cells["path"], cells["rank"]))
            at = [bisect_right(firsts, k) - 1 for k in keys]
            rows = list(range(batch.num_rows))
            where, guest = list(at), [0] * len(rows)
            for i, k in enumerate(keys):
                if k == firsts[at[i]] and at[i]:
                    rows.append(i), where.append(at[i] - 1), guest.append(1)
                if k == lasts[at[i]] and at[i] + 1 < len(firsts):
                    rows.append(i), where.append(at[i] + 1), guest.append(1)
            arrays = [pa.array([cells[c][i] for i in rows], type=pa.int64() if c == "page_id" else pa.string()) for c in PAGE]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(where, type=pa.int64()), pa.array(guest, type=pa.int32())], [*PAGE, "range", "guest"])

    def placed_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [first[0] for first in shared.value[0]]
        for batch in batches:
            spans = [(i, at) for i, name in enumerate(batch.column("host").to_pylist())
                     for at in range(max(0, bisect_left(firsts, name) - 1), bisect_right(firsts, name))]
            out = batch.take(pa.array([i for i, _ in spans], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([at for _, at in spans], type=pa.int64())], [*batch.schema.names, "range"])

    rows = pages.select(
        id_.alias("page_id"), column(url_column).cast("string").alias("url"), text_of(html_column).alias("html"),
        host.alias("host"), path.alias("path"), rank.alias("rank"))
    dealt = rows.mapInArrow(released(placed), "page_id long, url string, host string, path string, rank string, lines string, range long, guest int")
    spread = {first[0][0] for first, before in zip(bounds[1:], bounds) if first[0][0] == before[1][0]}  # one host a range at most
    hosts = host_rows(rows, pages.sparkSession.sparkContext.broadcast(frozenset(spread))).mapInArrow(
        released(placed_hosts), "host string, plain array<long>, declared array<long>, others array<array<long>>, range long")
    # a host's own rows have no rank and so stand before its pages
    dealt = dealt.unionByName(hosts, allowMissingColumns=True).repartition("range").sortWithinPartitions(
        "range", "host", F.col("rank").isNotNull(), "path", "rank", F.xxhash64("lines"))

    def texts(group: list[dict], host: Host, others: list[list[int]]) -> Iterator[tuple]:
        """The pages of a host in a range, with their texts."""
        held = [(lines, numbers(lines)) for lines in (unpacked(row.pop("lines")) for row in group)]
        for row, (lines, mine), *sides in zip(group, held, nearest(held, host, -1), nearest(held, host, 1)):
            if not row["guest"]:
                near = [side for side in sides if side]
                if near:
                    gone = max(near, key=lambda side: shared_path(row["path"], group[side[0]]["path"]))[1]
                else:
                    gone = next((x for x in (shared_lines(lines, mine, other, host) for other in others) if x is not None), None)
                yield row["page_id"], row["url"], alone(lines, host) if gone is None else kept(lines, mine, gone, host)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group: list[dict] = []
        host, others, now = Host(), [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["range"], row["host"]) != now:
                    yield from texts(group, host, others)
                    group, host, others, now = [], Host(), [], (row["range"], row["host"])
                if row["rank"] is not None:
                    group.append(row)
                elif row["plain"] is not None:
                    host = Host(frozenset(row["plain"]), frozenset(row["declared"]))
                else:
                    others = row["others"]
        yield from texts(group, host, others)

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "text"])

        done: list[tuple] = []
        held = 0
        for row in grouped(batches):
            done.append(row)
            held += len(row[2])
            if held > 4 << 20 or len(done) >= 2000:
                yield table(done)
                done, held = [], 0
        if done:
            yield table(done)

    return dealt.mapInArrow(released(differenced), "page_id long, url string, text string")

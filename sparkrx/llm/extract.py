"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path and neighbours are paired. The lines of the two pages are aligned by their longest common
subsequence and shared lines are deleted: what a site repeats from page to page is not its text. This decides every line of every page
that has a neighbour. Differencing alone cannot give right results on two kinds of line, so marked-up structure overrules it there:
shared lines within a page's article (or main) element stay, since articles may share a line or be quoted whole; and lines that no other
page has go if they lie within menus, headers, footers, sidebars, adverts, forms or comments, which a page may word for itself.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prefix_sums, sliced, spread_join, texts, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>?", re.S)
# fixed values: elements by what they mean for a page's text
RAW = frozenset("script style textarea title noscript template iframe svg math object select option canvas audio video head xmp noembed noframes".split())
BOILERPLATE = frozenset("nav header footer aside form menu button dialog fieldset label".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tag may be left out: a new one ends the one before.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-?bar|aside|widget|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|signup|login|form|search|share|sharing|social|related|recommended|comment|comments|replies|reply|disqus|respond)(?:$|[\s_-])", re.I
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Of the article; undecided; not of the article by tag; not of the article by class, id or role, unless an article begins within; an
#: element within a line that is not of the article, whose text is no part of the line.
KEEP, OPEN, DROP, WEAK, MUTE = 1, 0, -1, -2, -3
#: A longest common subsequence is found in one go where its rows take at most so many bits.
TABLE_BITS = 1 << 23


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    """DROP if an element's tag says that it is not of the article, WEAK if only its attributes do, else 0. inside: an article is open."""
    if tag in BOILERPLATE:
        return 0 if inside and tag == "header" else DROP
    if not attributes or tag in ("main", "html", "body"):
        return 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                return WEAK
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return DROP
        elif name == "style":
            if HIDDEN.search(value):
                return DROP
        elif name in ("class", "id") and (found := MARKED.search(value)) and not (inside and "header" in found[0].lower()):
            return WEAK
    return 0


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, KEEP | OPEN | DROP | WEAK) of each block of a page, in order: what differencing sees, and what structure says of it.

    White space is one space, references are decoded, a line break is white space. Unclosed elements, stray end tags, broken references
    and unclosed comments are taken roughly as browsers take them.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, each with what it makes of its text
    at, end, low, state, begun = 0, len(page), None, OPEN, OPEN

    def flush() -> None:
        line = " ".join(html.unescape("".join(parts)).split())
        if line:
            out.append((line, begun))
        parts.clear()

    def cut(depth: int) -> None:
        nonlocal state
        for i in range(len(stack) - 1, depth - 1, -1):
            if stack[i][0] in BLOCK:
                flush()
            state = stack[i - 1][1] if i else OPEN
        del stack[depth:]

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and state != MUTE and (parts or not page[at:stop].isspace()):
            if not parts:
                begun = state
            parts.append(page[at:stop])
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                cut(depth)
        elif tag in RAW:
            if m[3].endswith("/"):
                continue
            low = low or page.lower()
            close = low.find(f"</{tag}", at)
            body = low.find("<body", at) if tag == "head" else -1
            if body >= 0 and (close < 0 or body < close):
                at = body
            else:
                close = page.find(">", close) if close >= 0 else -1
                at = close + 1 if close >= 0 else end
            if parts:
                parts.append(" ")
        elif tag in VOID:
            if parts and tag in ("br", "img", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
        else:
            if tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES.get(tag, ()):
                        cut(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            now, bad = state, _boilerplate(tag, m[3], state == KEEP)
            if now != DROP and bad:
                now = bad
            elif tag in MAIN and now in (OPEN, WEAK):
                now = KEEP
            if now in (DROP, WEAK) and (state == MUTE or state >= OPEN and tag not in BLOCK):
                now = MUTE
            stack.append((tag, now))
            state = now
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` on a longest common subsequence of two lists of line hashes.

    Equal beginnings and ends are stripped and lines the other page lacks are left out. What remains is aligned by the classical
    recurrence, whose rows are integers of bits; where all rows together would be large, the lists are halved (Hirschberg), so that
    memory grows in proportion to the pages.
    """
    found: set[int] = set()
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        found.add(i)
        i += 1
    ea, eb = len(a), len(b)
    while ea > i and eb > i and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        found.add(ea)
    other = set(b[i:eb])
    left = [k for k in range(i, ea) if a[k] in other]
    mine = {a[k] for k in left}
    right = [x for x in b[i:eb] if x in mine]
    todo = [(left, right)]
    while todo:
        left, right = todo.pop()
        if not left or not right:
            continue
        if len(left) == 1:
            found.update(left if a[left[0]] in right else ())
        elif len(left) * len(right) <= TABLE_BITS:
            found |= _aligned(a, left, right)
        else:
            mid = len(left) // 2
            head = _lengths([a[k] for k in left[:mid]], right)
            tail = _lengths([a[k] for k in left[:mid - 1:-1]], right[::-1])
            cut = int((head + tail[::-1]).argmax())
            todo += [(left[:mid], right[:cut]), (left[mid:], right[cut:])]
    return found


class _Rows:
    """Rows of the recurrence over ``right``: a zero bit at j says that the subsequence grows at right[j]."""

    def __init__(self, right: list[int]):
        self.full, self.kept = (1 << len(right)) - 1, {}
        self.at: dict[int, list[int]] = {}
        for j, x in enumerate(right):
            self.at.setdefault(x, []).append(j)

    def places(self, line: int) -> int:
        at = self.at.get(line, ())
        if len(at) < 8:
            return sum(1 << j for j in at)
        if line not in self.kept:  # at most one in eight lines
            bits = np.zeros(self.full.bit_length(), np.uint8)
            bits[at] = 1
            self.kept[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self.kept[line]

    def after(self, row: int, line: int) -> int:
        u = row & self.places(line)
        return (row + u | row - u) & self.full


def _lengths(lines: list[int], right: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``lines`` and right[:j], for each j from 0."""
    rows = _Rows(right)
    row = rows.full
    for x in lines:
        row = rows.after(row, x)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(right) // 8), "little"), np.uint8), bitorder="little")[: len(right)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], left: list[int], right: list[int]) -> set[int]:
    table = _Rows(right)
    rows = [table.full]
    for k in left:
        rows.append(table.after(rows[-1], a[k]))
    found, j = set(), len(right)

    def length(r: int, upto: int) -> int:
        return upto - (r & (1 << upto) - 1).bit_count()

    for n in range(len(left), 0, -1):
        if j and length(rows[n], j) > length(rows[n - 1], j):
            while length(rows[n], j - 1) == length(rows[n], j):
                j -= 1
            found.add(left[n - 1])
            j -= 1
    return found


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line, 3) - (1 << 63)


def differenced(pages: DataFrame) -> DataFrame:
    """page_id, url, __states (of each line), __texts (of the lines that are not ruled out) and __shared (whether each line is shared; null
    without a neighbour) of every page.

    Pages of a host with equal lines are one page when neighbours are paired, so a copy is compared with the nearest page that differs.
    Pages are parsed twice, once for the hashes of their lines, which are kept, and once for the lines, which move to their decisions
    once, without the text that markup rules out whatever a neighbour holds. Hosts are joined by their hashes, beside the lists' own.
    """
    schema = "page_id {}, url string, __lines array<struct<line:string,state:tinyint>>, __hashes array<long>, __list long".format(pages.schema["page_id"].dataType.simpleString())

    def parse(batches):
        for b in sliced(batches, "html"):
            rows = [blocks(t.decode("utf-8", "replace")) for t in texts(b, "html")]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lines = pa.array([t for r in rows for t, _ in r], pa.string())
            cells = pa.StructArray.from_arrays([lines, pa.array([s for r in rows for _, s in r], pa.int8())], ["line", "state"])
            hashes = [[line_hash(t) for t, _ in r] for r in rows]
            whole = [xxhash.xxh64_intdigest(np.array(h, np.int64).tobytes(), 5) - (1 << 63) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.ListArray.from_arrays(ends, cells), pa.array(hashes, pa.list_(pa.int64())), pa.array(whole, pa.int64())], names=["page_id", "url", "__lines", "__hashes", "__list"]
            )

    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    placed = pages.select("page_id", "url", "html").mapInArrow(parse, schema)
    host, path = F.coalesce(F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    placed = placed.withColumn("__host", host).withColumn("__path", path)
    hashed = written(placed.select("__host", "__path", "__hashes", "__list"), "page-hashes")
    lists = hashed.groupBy("__host", "__list").agg(F.min("__path").alias("__path"), F.first("__hashes").alias("__hashes")).withColumn("__one", F.lit(1).cast("long"))
    ranked = written(prefix_sums(lists, ["__host"], ["__path", "__list"], {"__one": "__rank"}, "page-order"), "page-ranks")
    hosts = ranked.groupBy(F.col("__host").alias("__h")).agg(F.count("*").alias("__n"))
    ranked = spread_join(ranked, hosts, [("__host", "__h")], F.col("__list"), "inner")
    # pairs (0, 1), (2, 3), ...; an odd page at the end joins the pair before it
    pair = F.least(F.floor(F.col("__rank") / 2), F.greatest(F.floor(F.col("__n") / 2) - 1, F.lit(0)))
    near = W.partitionBy("__host", pair).orderBy("__rank")
    paired = ranked.withColumn("__other", F.coalesce(F.lag("__hashes").over(near), F.lead("__hashes").over(near))).where("__other is not null")

    def shared(batches):
        for b in batches:
            pairs = zip(b.column("__hashes").to_pylist(), b.column("__other").to_pylist())
            cells = []
            for x, y in pairs:
                on = np.zeros(len(x), bool)
                on[list(common_lines(x, y))] = True
                cells.append(on)
            yield pa.RecordBatch.from_arrays([b.column("__host"), b.column("__list"), pa.array(cells, pa.list_(pa.bool_()))], names=["__h", "__l", "__shared"])

    drops = written(paired.select("__host", "__list", "__hashes", "__other").mapInArrow(shared, "__h string, __l long, __shared array<boolean>"), "shared-lines")
    states = F.transform("__lines", lambda x: x["state"])
    kept = F.transform(F.filter("__lines", lambda x: x["state"] >= OPEN), lambda x: x["line"])
    moved = placed.select("page_id", "url", states.alias("__states"), kept.alias("__texts"), F.xxhash64("__host").alias("__host"), "__list")
    rows = spread_join(moved, drops.withColumn("__h", F.xxhash64("__h")), [("__host", "__h"), ("__list", "__l")], F.col("page_id"), grows=True)
    return rows.select("page_id", "url", "__states", "__texts", "__shared")


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_overruled for every row of ``pages`` (page_id, url, html).

    n_lines are the page's lines, n_overruled those in which structure overruled differencing. A null or empty page has the empty text.
    Hosts and paths are read from the url; pages without one form a host of their own. The last page of a host of odd size is compared
    with the one before it. A host's only page is compared with none: all its lines count as its own. Without ``differencing`` no line
    is shared. Repeated rows get equal texts. Whole pages are read. An empty table gives no rows.
    """
    rows = differenced(pages)
    lines = F.transform("__states", lambda x, i: F.struct(x.alias("state"), (F.coalesce(F.get("__shared", i), F.lit(False)) & F.lit(differencing)).alias("shared")))
    rows = rows.select("page_id", "url", "__texts", lines.alias("__lines"))
    beside = F.zip_with("__texts", F.filter("__lines", lambda x: x["state"] >= OPEN), lambda t, x: F.struct(t.alias("line"), x["state"].alias("state"), x["shared"].alias("shared")))
    stays = F.filter(beside, lambda x: (x["state"] == KEEP) | ~x["shared"])
    over = F.filter("__lines", lambda x: (x["state"] == KEEP) & x["shared"] | (x["state"] < OPEN) & ~x["shared"])
    text = F.array_join(F.transform(stays, lambda x: x["line"]), "\n")
    rows = rows.select("page_id", "url", text.alias("text"), F.size("__lines").alias("n_lines"), F.size(over).alias("n_overruled"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_overruled")

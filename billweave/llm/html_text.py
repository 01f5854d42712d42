"""Main text of HTML pages by site template removal.

Each page is parsed into blocks of text, over the whole page. Left out are blocks inside an element that is never content by its tag
or role (menus, asides, forms, scripts, headers outside an article and so on), or by a class or id that names such a thing and says
nothing else (``ad-slot-top``, ``user-comments``, but not ``header-image-story``). What else stands around the article is for the
templates: elements are hashed as subtrees, Spark counts on how many different pages of a host each hash stands, and subtrees that
recur are deleted, whatever they are called. Counting combines in the map tasks and is keyed by host and hash, so a large host is
spread over many keys. Parsing is linear in the page, however deep it nests.

* Outside an article a container that recurs on ``MIN_SHARE`` of its host's pages is a template. Prose elements there, and text
  that stands directly in a container, may be the text of a page without an article: they are templates on half of the pages only.
* Inside ``article`` or ``main`` prose is never a template, however often it recurs: a passage that many articles share is text of
  each. A container is one if it recurs on half of the pages.
* A subtree that holds more than half of a page's text is none. Where templates by the share of half leave less than ``LEAST_LEFT``
  of the text, the pages are near copies, and they stay.
* Of what is left, a page whose articles hold a quarter or more is its articles; otherwise they are teasers, and all is kept.

Different pages means pages with different main text, so copies of one article do not make it a template. A host of fewer than
``MIN_PAGES`` different pages has no templates: there tags, roles and names decide alone.

Defined results: null or empty html gives an empty text; repeated rows are extracted each on its own; an empty table
gives no rows; a null url makes a host of its own; extra columns are ignored; unclosed and stray tags are accepted.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from html import unescape
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, map_rows

#: A subtree is a template if it stands on this many different pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 10, 0.02
#: The share for what may be text, the share of a page's text that taking it out must leave, and the share that makes articles the page.
TEXT_SHARE, LEAST_LEFT, MAIN_SHARE = 0.5, 0.1, 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
NEVER = frozenset("nav footer aside form button select menu dialog fieldset head label input datalist audio video canvas".split()) | RAW
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody thead tr td th figure figcaption".split())
#: Prose elements that mean something in their table or list only.
PARTS = frozenset("dt dd tbody thead tr td th".split())
#: Start tags that end an open element of the same group.
_CLOSES = {t: frozenset(g) for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}
#: Words in class names and ids of adverts, notices and readers' comments, and of other things around a text.
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo banner cookie cookies consent notice gdpr popup modal overlay "
    "comment comments commentlist disqus replies reply respond share sharing social related recommended newsletter subscribe signup".split()
)
AROUND = ASIDES | frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead login search widget toolbar pagination pager skip".split())
#: Words that say where and how such a thing stands, and nothing about what it is.
WHERE = frozenset(
    "top bottom left right middle main side site page global primary secondary upper lower inner outer sticky fixed mobile desktop user users reader readers slot box bar list "
    "links link wrap wrapper container section area block unit row col column panel group item items inline text buttons button form thread content holder zone space label title".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def says_only(name: str, words: frozenset[str]) -> bool:
    """Whether a class name or id has one of the words, and else only words of places."""
    parts = {p.lower() for p in _WORDS.split(name) if p}
    return not words.isdisjoint(parts) and parts <= AROUND | WHERE


def never_content(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never content (by its tag or role, by a class or id)."""
    if tag in NEVER or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in ("html", "body", "main", "article"):
        return False, False
    at = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)}
    if "hidden" in at or at.get("aria-hidden") == "true" or at.get("role") in _ROLES:
        return True, False
    names = [*at.get("class", "").split()] if in_article and tag in PROSE else [*at.get("class", "").split(), *at.get("id", "").split()]
    return False, any(says_only(name, ASIDES if in_article else AROUND) for name in names)


class _Element:
    """``drop``: never content by its tag or role; ``named``: the innermost element around it, or itself, that a name makes so;
    ``main``: whether an article begins in it."""

    __slots__ = ("article", "drop", "gone", "hash", "main", "named", "node", "parent", "size", "tag")

    def __init__(self, tag: str, parent: _Element | None, drop: bool, named: bool, article: bool):
        self.tag, self.parent, self.drop, self.article, self.hash, self.size, self.node = tag, parent, drop, article, xxhash.xxh64(tag), 0, -1
        self.named, self.main, self.gone = self if named else parent.named if parent is not None else None, False, False


def parse(html: str) -> list[tuple[str, _Element | None]]:
    """(text, innermost element) of each block of a page in order; the elements' hashes and sizes are final.

    An element with such a name goes if no article begins in it: ``sidebar-right`` may say how a whole page is laid out.
    """
    stack: list[_Element] = []
    named: list[_Element] = []
    blocks: list[tuple[str, _Element | None]] = []
    held: list[str] = []
    opened: Counter = Counter()
    at, n = 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text and not (stack and stack[-1].drop):
                if stack:
                    stack[-1].size += len(text)
                blocks.append((text, stack[-1] if stack else None))

    def close(k: int) -> None:
        """Pop all elements from place ``k``."""
        if any(e.tag in BLOCK or e.drop or e.named is e for e in stack[k:]):
            flush()
        while len(stack) > k:
            e = stack.pop()
            opened[e.tag] -= 1
            if stack:
                stack[-1].hash.update(e.hash.digest())
                stack[-1].size += e.size

    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            held.append(text)
            if stack:
                stack[-1].hash.update(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body"):
                for k in range(len(stack) - 1, -1, -1):  # a block start ends an open paragraph
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
        group = _CLOSES.get(tag)
        if group:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in group:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
                    break
        above = stack[-1] if stack else None
        inside = above is not None and above.article
        by_tag, by_name = never_content(tag, m[3], inside)
        drop = above is not None and above.drop or by_tag
        if drop or by_name:
            flush()
        begins = tag in ("article", "main")
        stack.append(_Element(tag, above, drop, by_name, inside or begins))
        opened[tag] += 1
        if by_name:
            named.append(stack[-1])
        around = stack[-1].named if begins else None
        while around is not None and not around.main:
            around.main = True
            around = around.parent.named if around.parent is not None else None
    flush()
    close(0)
    for e in named:  # outer ones first
        e.gone = not e.main or e.parent is not None and e.parent.named is not None and e.parent.named.gone
    return [b for b in blocks if b[1] is None or b[1].named is None or not b[1].named.gone]


class Page(NamedTuple):
    """A page's text. ``nodes``: (place of the node around it or -1, mark or 0), outer ones first; ``blocks``: (text, place of its
    node or -1, own mark or 0, whether in an article). A mark is the hash of what may be a template; those of what may be text are
    odd, others even."""

    nodes: list[tuple[int, int]]
    blocks: list[tuple[str, int, int, bool]]

    def marks(self) -> set[int]:
        return {m for _, m in self.nodes if m} | {b[2] for b in self.blocks if b[2]}


def page_blocks(html: str) -> Page:
    blocks = parse(html)
    whole = sum(len(t) for t, _ in blocks)

    def mark(e: _Element) -> int:
        prose = e.tag in PROSE
        if e.tag in ("html", "body", "article", "main") or e.tag not in BLOCK or prose and (e.article or e.tag in PARTS) or 2 * e.size > whole and not prose:
            return 0
        return e.hash.intdigest() - (1 << 63) & -2 | (prose or e.article)

    nodes: list[tuple[int, int]] = []
    out = []
    for text, e in blocks:
        fresh, holder = [], e
        while holder is not None and holder.node < 0:
            fresh.append(holder)
            holder = holder.parent
        for x in reversed(fresh):
            x.node = len(nodes)
            nodes.append((x.parent.node if x.parent is not None else -1, mark(x)))
        inside = e is not None and e.article
        while e is not None and e.tag not in BLOCK and e.parent is not None:
            e = e.parent
        direct = e is not None and not inside and e.tag not in PROSE  # text directly in a container
        out.append((text, blocks_node(fresh, holder), xxhash.xxh64_intdigest(f"{e.tag} {text}") - (1 << 63) | 1 if direct else 0, inside))
    return Page(nodes, out)


def main_part(blocks: list[tuple[str, bool]]) -> list[str]:
    """The articles' texts of (text, whether in an article), or all of them where articles are a small part only."""
    inner = [t for t, inside in blocks if inside]
    return inner if inner and sum(map(len, inner)) >= MAIN_SHARE * sum(len(t) for t, _ in blocks) else [t for t, _ in blocks]


def blocks_node(fresh: list[_Element], known: _Element | None) -> int:
    """The node of the innermost element of a block."""
    return fresh[0].node if fresh else known.node if known is not None else -1


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def _row():
    """A row by 128 bits of hash."""
    return F.xxhash64("page_id", "url", "html").alias("row"), F.xxhash64(F.lit("again"), "page_id", "url", "html").alias("again")


def _host():
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), _HOST, 1))).alias("host")


def host_blocks(html: str, host: int) -> Page:
    """``page_blocks`` with marks that differ from those of other hosts."""
    seed = host & 0xFFFFFFFFFFFFFFFF
    page = page_blocks(html)
    own = {m: xxhash.xxh64_intdigest(m.to_bytes(8, signed=True), seed) - (1 << 63) & -2 | m & 1 for m in page.marks()}
    return Page([(up, own.get(m, 0)) for up, m in page.nodes], [(text, node, own.get(m, 0), inside) for text, node, m, inside in page.blocks])


def marked(pages: DataFrame) -> DataFrame:
    """``row, again, host, page, marks`` of every row: hashes of the row, its host and main text, and of its possible templates."""

    def make():
        def work(columns):
            found = list(map(host_blocks, columns[-1], columns[-2]))
            texts = [xxhash.xxh64_intdigest(" ".join(main_part([(b[0], b[3]) for b in p.blocks]))) - (1 << 63) for p in found]
            return [*columns[:-1], texts, [sorted(p.marks()) for p in found]]

        return work

    rows = pages.select(*_row(), _host(), F.coalesce("html", F.lit("")).alias("text"))
    return map_rows(rows, make, "row long, again long, host long, page long, marks array<long>")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """``mark``: subtree hashes of ``marked`` pages that recur on many different pages of their host."""
    each = found.groupBy("host", "page").agg(F.array_distinct(F.flatten(F.collect_set("marks"))).alias("marks"))
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    often = each.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    share = F.when(F.col("mark").bitwiseAND(1) == 1, text_share).otherwise(min_share)
    return often.join(sizes, "host").where(F.col("n") >= share * F.col("n_host")).select("mark")


def left_of(page: Page, gone: set[int]) -> list[str]:
    """The texts of the main part's blocks without templates."""
    state = [(False, False)]  # (in a template, in one or a template of what may be text) of each node; last, of no node
    for up, m in page.nodes:
        above, hit = state[up + 1], m in gone
        state.append((above[0] or hit and not m & 1, above[1] or hit))
    own = [(text, inside, state[node + 1][1] or m in gone) for text, node, m, inside in page.blocks if not state[node + 1][0]]
    rest = [(text, inside) for text, inside, hit in own if not hit]
    return main_part(rest if sum(len(t) for t, _ in rest) >= LEAST_LEFT * sum(len(t) for t, _, _ in own) else [(t, inside) for t, inside, _ in own])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """``page_id, url, text`` of every row.

    Pages are parsed once for the hashes, which are small and kept, and once for the text. Where all pages' templates together are
    ``SMALL`` they go to the pages; otherwise the pages' blocks go, compressed, to where their templates are known.
    """
    key = pages.schema["page_id"].dataType.simpleString()
    found = cut(marked(pages))
    # copies of a row share its hash, and have the same marks
    hit = found.select("row", "again", F.explode("marks").alias("mark")).join(templates(found, min_pages, min_share, text_share), "mark")
    gone = cut(hit.groupBy("row", "again").agg(F.collect_set("mark").alias("gone")))
    rows = pages.select(*_row(), "page_id", "url", _host(), F.coalesce("html", F.lit("")).alias("text"))
    out = f"page_id {key}, url string, text string"

    def text_left():
        return lambda c: [*c[:2], [" ".join(left_of(host_blocks(html, host), set(g or ()))) for g, host, html in zip(*c[2:])]]

    def pack():
        return lambda c: [*c[:-2], [zlib.compress(json.dumps(host_blocks(html, host), ensure_ascii=False).encode("utf-8", "surrogatepass"), 3) for host, html in zip(*c[-2:])]]

    def unpack():
        return lambda c: [*c[:-2], [" ".join(left_of(Page(*json.loads(zlib.decompress(b).decode("utf-8", "surrogatepass"))), set(g or ()))) for g, b in zip(*c[-2:])]]

    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= SMALL:
        return map_rows(rows.join(F.broadcast(gone), ["row", "again"], "left").select("page_id", "url", "gone", "host", "text"), text_left, out)
    parsed = map_rows(rows, pack, f"row long, again long, page_id {key}, url string, blocks binary")
    return map_rows(parsed.join(gone, ["row", "again"], "left").select("page_id", "url", "gone", "blocks"), unpack, out)

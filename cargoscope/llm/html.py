"""Main text of web pages, with site templates found by recurring subtrees.

A page is parsed once into blocks of text and the hashes of its element subtrees. Spark counts the subtrees of every
page per host, and those that recur on many pages of a host are the site's template: blocks in them are deleted. If
the page marks its article (``article``, ``main`` or ``role=main``), the mark protects the blocks inside it from that,
as a passage may recur in articles; blocks outside it are kept unless they recur. Markup that never holds the article
(navigation, headers, footers, asides, forms, scripts, styles, and elements whose class, id or role says advert,
notice, menu, comments and the like) is left out by name as well, as it needn't recur; its subtrees are counted too.

Counting is a partially aggregated group per (host, hash); a host with a third of all pages costs no task more than
another. Hashes are joined back to the pages that hold them; nothing is gathered per host.

Names: a class or id is boilerplate if one of its tokens says so as a whole (``ad-slot``, ``site-footer``), not by one word
of many (``side-by-side``, ``has-sidebar``). A marked article is never left out through the class of an element around
it or a form around the page, only through a navigation, footer, aside or the like; an article marked as a reader comment
is left out. Headers are left out wherever they are, an article's own ones as well.

Defined results: a null or empty page has the empty text; broken markup is read as browsers do in spirit (unclosed
elements end with their parent, unknown end tags are ignored); a null url belongs to no host, and its pages lose no
recurring subtrees; repeated rows are pages of their own; an empty table gives an empty result; extra input columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut, per_row, text_or_empty

#: A subtree is part of the template if it is on at least so many pages of the host and so large a share of them.
MIN_PAGES = 10
MIN_SHARE = 0.05

# Elements of the HTML standard by what they mean here.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg".split())
#: Without an end tag these take the rest of the page with them, as in browsers; the others only end themselves.
TO_END = frozenset(["script", "style"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option dialog menu object canvas audio video label fieldset input".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(["article", "main"])
CLOSES_P = BLOCK - {"br", "html", "body"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMITS = frozenset("ul ol dl table article section div main body html td th blockquote".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies "
    "consent gdpr notice notices banner popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead footer comment comments reply replies respond disqus share sharing social related newsletter subscribe "
    "subscription signup login search pagination pager toolbar widget skip".split()
)
#: Words that a boilerplate token may hold beside one of those above.
NEUTRAL_WORDS = frozenset("site page main top bottom left right global primary secondary box bar bars block area slot unit list item items wrap wrapper container inner outer section panel content links link text form thread policy message js the v1 v2".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("subtrees", pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32()), ("marked", pa.bool_())])))])
_DDL = "page_id long, url string, host string, subtrees array<struct<hash:long, first:int, end:int>>, blocks array<struct<text:string, place:int, marked:boolean>>"


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(source)}


def _says(found: dict[str, str], words: frozenset) -> bool:
    """One of the class and id tokens holds one of the words, and else only neutral ones and numbers."""
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = _WORD.findall(_CAMEL.sub(" ", token).lower())
        if any(p in words for p in parts) and all(p in words or p in BOILERPLATE_WORDS or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
            return True
    return False


def left_out(tag: str, found: dict[str, str]) -> int:
    """0: not left out; 1: left out, but for a marked article inside; 2: left out whole."""
    if tag in MAIN:
        return 2 if _says(found, COMMENT_WORDS) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" else 0
    if tag == "form":
        return 1
    if tag in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return 2
    role = found.get("role", "").lower()
    if role in BOILERPLATE_ROLES:
        return 1 if role == "form" else 2
    return 1 if tag not in ("html", "body") and _says(found, BOILERPLATE_WORDS) else 0


class _Open:
    """An open element: what it is, the element that its blocks belong to (itself unless inline), where its blocks
    start, and the digest of what it holds so far."""

    __slots__ = ("tag", "dropped", "whole", "main", "box", "first", "digest")

    def __init__(self, tag: str, dropped: bool, whole: bool, main: bool, outer: _Open | None, first: int, kind: str) -> None:
        self.tag, self.dropped, self.whole, self.main, self.first = tag, dropped, whole, main, first
        self.box = self if tag in BLOCK or tag in DROPPED else outer
        self.digest = xxhash.xxh3_64(kind)


def blocks(source: str) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int, int]]]:
    """Blocks of candidate text in page order (text, place, whether a mark protects it), and the page's subtrees that
    hold text (hash, place of the first block, place after the last one): as many as there are elements."""
    out: list[tuple[str, bool, bool]] = []  # text, in a marked article, left out by name
    subtrees: list[tuple[int, int, int]] = []
    stack: list[_Open] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                box = stack[-1].box if stack else None
                out.append((text, bool(stack and stack[-1].main), bool(box and box.dropped)))
                if box:
                    box.digest.update("\0" + text)

    def close() -> None:
        if stack[-1].tag not in BLOCK and stack[-1].tag not in DROPPED:
            stack.pop()  # inline: its text is part of the block around it
            return
        flush()
        e = stack.pop()
        h = e.digest.intdigest()
        outer = stack[-1].box if stack else None
        if outer and (outer.dropped or not e.dropped):  # an advert that differs doesn't hide the box around it
            outer.digest.update(h.to_bytes(8, "big"))
        if e.tag not in ("html", "body") and len(out) > e.first:
            subtrees.append((h - (1 << 64) if h >> 63 else h, e.first, len(out)))

    def text(piece: str) -> None:
        e = stack[-1] if stack else None
        if piece and not (e and e.dropped and not (e.box and e.box.dropped)):  # an inline element left out has no subtree
            parts.append(entities.unescape(piece))

    at = 0
    while found := _TAG.search(source, at):
        text(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCK or tag in DROPPED:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        close()
                    break
            continue
        if tag in RAW:
            if tag in ("svg", "template") and (found[3] or "").endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source) if tag in TO_END else at
            continue
        if tag in BLOCK or tag in DROPPED:
            flush()
            if tag in CLOSES_P or tag in DROPPED:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        while len(stack) > i:
                            close()
                        break
                    if stack[i].tag in LIMITS or stack[i].tag in DROPPED:
                        break
            for i in range(len(stack) - 1, -1, -1) if tag in SELF_CLOSING else ():
                if stack[i].tag in SELF_CLOSING[tag]:
                    while len(stack) > i:
                        close()
                    if tag != "tr" or not any(e.tag in ("td", "th", "tr") for e in stack):
                        break
                elif stack[i].tag in LIMITS - {"td", "th"}:
                    break
        if tag in VOID or (found[3] or "").endswith("/") and tag not in BLOCK:
            continue
        own = attributes(found[3]) if found[3] and found[3].strip() else {}
        outer = stack[-1] if stack else None
        main = tag in MAIN or own.get("role", "").lower() == "main" or own.get("itemprop", "") == "articleBody"
        out_by = left_out(tag, own)
        whole = bool(outer and outer.whole) or out_by == 2
        dropped = whole or not main and (bool(outer and outer.dropped) or out_by == 1)
        stack.append(_Open(tag, dropped, whole, bool(outer and outer.main) or main and not dropped, outer.box if outer else None, len(out), f"{tag} {own.get('class', '')} {own.get('id', '')}"))
    rest = source[at:]
    text(rest if "<" not in rest else re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", rest))
    while stack:
        close()
    flush()
    return [(t, place, main) for place, (t, main, dropped) in enumerate(out) if not dropped], subtrees


def _parse():
    def one(row: dict) -> Iterator[dict]:
        kept, subtrees = blocks(row["html"])
        yield {"page_id": row["page_id"], "url": row["url"], "host": row["host"], "subtrees": [{"hash": h, "first": a, "end": b} for h, a, b in subtrees], "blocks": [{"text": t, "place": p, "marked": m} for t, p, m in kept]}

    return one


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), text_or_empty("html").alias("html"))
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    rows = rows.withColumn("host", F.when(host != "", host)).select("page_id", "url", "host", "html")
    # The number of a row is written with it, so it stays the same however often the table is read.
    parsed = cut(rows.mapInArrow(per_row(_SCHEMA, _parse), _DDL).withColumn("row", F.monotonically_increasing_id()))
    around = parsed.where("host is not null").select("row", "host", F.explode(F.array_distinct("subtrees.hash")).alias("subtree"))
    seen = around.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    of_host = parsed.where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    template = cut(seen.join(of_host, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "subtree"))
    # Every page is counted; only pages with blocks outside a marked article can lose any, so the others aren't moved.
    is_open = F.exists("blocks", lambda b: ~b["marked"])
    open_around = parsed.where(is_open & F.col("host").isNotNull()).select("row", "host", F.explode(F.array_distinct("subtrees.hash")).alias("subtree"))
    lost = open_around.join(template, ["host", "subtree"], "left_semi").groupBy("row").agg(F.collect_list("subtree").alias("lost"))
    gone = F.filter("subtrees", lambda s: F.array_contains("lost", s["hash"]))
    joined = parsed.where(is_open).join(lost, "row", "left").withColumn("gone", gone).drop("lost")
    joined = joined.unionByName(parsed.where(~is_open).withColumn("gone", F.lit(None).cast("array<struct<hash:long, first:int, end:int>>")))
    inside = lambda b: F.exists("gone", lambda s: (s["first"] <= b["place"]) & (b["place"] < s["end"]))
    left = F.filter("blocks", lambda b: b["marked"] | ~F.coalesce(inside(b), F.lit(False)))
    text = F.array_join(F.transform(left, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

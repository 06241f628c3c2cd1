"""Main text of web pages by two-pass block rules.

A page is cut at block elements. Pass 1 labels each block by itself: blocks in menus, footers, adverts and the like, and
blocks that are mostly links, are bad; long ones with many function words are good; short ones, and longer ones with few
function words, stay open. Pass 2 gives an open block the labels of the nearest decided blocks of its part of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Blocks under so many characters are short; from LONG on, function words alone make a block good.
SHORT, LONG = 70, 200
#: Share of function words from which a block reads as prose, and of link text beyond which it is bad outside and inside
#: an article.
PROSE, LINKED, LINKED_INSIDE = 0.30, 0.20, 0.50
FUNCTION_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or other our she so some such than that the their them then there these they this to "
    "up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war werden wie wir zu "
    "zum zur au aux avec ce cette ces dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qui que sa se ses son sont sur un une vous "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me muy no o para pero por que se ser si sin sobre su sus también un una y ya".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Text inside is no text of the page; of the first three nothing is read as markup either.
RAW = frozenset(["script", "style", "textarea"])
UNREAD = RAW | frozenset("audio button canvas datalist head iframe noscript object option select svg template title video".split())
BOILERPLATE = frozenset(["nav", "footer", "aside", "dialog", "menu"])
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Opening one of these closes what is open of the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th"}),
}
#: Words of class, id and role that name boilerplate, wherever it stands, and such that name it outside articles only.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar complementary menu nav navbar navigation breadcrumb breadcrumbs footer "
    "contentinfo comment comments commentlist respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager widget alertdialog "
    "search copyright".split()
)
OUTSIDE_HINTS = frozenset(["header", "masthead", "alert", "legal", "form", "topbar"])
ARTICLE_NAMES = frozenset("article articlebody article-body article-content content main maincontent main-content post post-body post-content entry entry-content story story-body".split())
#: A tag whose attributes may hold ">" in quotes, and one that ends at the first ">".
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SIMPLE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>()()")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    state: str
    label: str = ""


@dataclass(slots=True)
class Open:
    """An open element and the state of text right inside it: unread, bad, form, article or plain."""

    name: str
    state: str
    link: bool
    heading: bool


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def state_inside(name: str, raw: str, parent: Open) -> str:
    """The state of text in an element of this name and these attributes, from its parent's."""
    if parent.state in ("unread", "bad"):
        return parent.state
    if name in UNREAD:
        return "unread"
    if name in BOILERPLATE:
        return "bad"
    at = attributes(raw)
    if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return "unread"
    inside = parent.state == "article"
    names = f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')} {at.get('itemprop', '')}".lower().split()
    if name not in ("html", "body", "main") and name not in HEADINGS:
        words = {w for n in names if not n.startswith(("has-", "with-", "no-")) for w in (n, *re.split(r"[-_:]+", n))}
        if words & HINTS or (not inside and words & OUTSIDE_HINTS):
            return "bad"
    if name in ("article", "main") or ARTICLE_NAMES.intersection(names):
        return "article"
    if name == "form":
        return "form"
    if name == "header":
        return "header" if inside else "bad"
    return "article" if parent.state == "header" and name in HEADINGS else parent.state


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; unclosed and stray tags are taken as browsers take them, roughly."""
    out: list[Block] = []
    stack, count = [Open("", "plain", False, False)], Counter()
    parts: list[str] = []
    linked = breaks = at = 0
    held = "plain"  # the state of the text in parts

    def flush() -> None:
        nonlocal linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, held))
        parts.clear()
        linked = breaks = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            count[stack.pop().name] -= 1

    def read(raw: str) -> None:
        nonlocal linked, breaks, held
        if raw and stack[-1].state != "unread":
            held = stack[-1].state
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                breaks = 0
                linked += len(text.strip()) if stack[-1].link else 0

    last, quotes, start = page.rfind(">"), True, -1
    while 0 <= (start := page.find("<", max(at, start + 1))):
        if page.startswith("<!--", start):
            read(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end > 0 else len(page)
            continue
        if start > last:
            break  # no tag can end any more
        m = quotes and TAG.match(page, start)
        if not m and (m := SIMPLE_TAG.match(page, start)) and m[2]:
            quotes = False  # a quote stays open to the page's end: from here on none counts
        if not m:
            continue  # a mere "<"
        read(page[at:start])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name in VOID and name != "hr":
            continue
        # an element of another state is a cut of its own, block element or not
        if m[1]:
            if count[name] > 0:
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                if name in BLOCK or stack[place].state not in ("unread", stack[place - 1].state):
                    flush()
                close(place)
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            if count["p"] > 0:
                place = len(stack) - 1
                while stack[place].name != "p":
                    place -= 1
                close(place)
        if count["head"] > 0 and name not in IN_HEAD:
            close(next(i for i, x in enumerate(stack) if x.name == "head"))
        if name in IMPLIED:
            closes, barrier = IMPLIED[name]
            if any(count[c] > 0 for c in closes):
                place = len(stack) - 1
                while place > 0 and stack[place].name not in closes and stack[place].name not in barrier:
                    place -= 1
                if place > 0 and stack[place].name in closes:
                    close(place)
        if name == "hr":
            continue
        state = state_inside(name, m[3], stack[-1])
        if state != stack[-1].state and state != "unread":
            flush()
        stack.append(Open(name, state, stack[-1].link or name == "a", stack[-1].heading or name in HEADINGS))
        count[name] += 1
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    read(page[at:])
    flush()
    return out


def label_alone(block: Block) -> str:
    """Pass 1: good, bad or open ("")."""
    if block.state in ("bad", "form", "header"):
        return "bad"
    inside, n = block.state == "article", len(block.text)
    if block.linked > n * (LINKED_INSIDE if inside else LINKED) or (not inside and ("©" in block.text or (n < SHORT and block.linked))):
        return "bad"
    if n < SHORT:
        return ""
    words = WORD.findall(block.text.lower())
    prose = bool(words) and sum(w in FUNCTION_WORDS for w in words) >= PROSE * len(words)
    return "good" if prose and (inside or n > LONG) else "" if prose or inside else "bad"


def label_by_neighbours(run: list[Block], inside: bool, default: str) -> None:
    """Pass 2 over the blocks of one part of the page. Between different neighbours the nearer one counts, the bad one of
    two as near. In an article, of which only boilerplate may go, one good neighbour is enough, and its ends count as good."""
    ahead: list[tuple[int, str]] = []
    last = (-1, "")
    for i in range(len(run) - 1, -1, -1):
        last = (i, run[i].label) if run[i].label else last
        ahead.append(last)
    ahead.reverse()
    before = (-1, "")
    for i, block in enumerate(run):
        if block.label:
            before = (i, block.label)
            continue
        found = [(abs(i - at), label) for at, label in (before, ahead[i]) if label]
        if not found:
            block.label = default
        elif inside:
            block.label = "bad" if [label for _, label in found] == ["bad", "bad"] else "good"
        else:
            block.label = min(found)[1]


def extract(page: str | None) -> str:
    """The main text: good blocks in page order, joined by line ends. If any block stands in an article, no block outside
    one is good; if nothing else is known, short blocks that no element marks as boilerplate are."""
    found = blocks(page or "")
    for b in found:
        b.label = label_alone(b)
    inside, outside = [b for b in found if b.state == "article"], [b for b in found if b.state == "plain"]
    label_by_neighbours(inside, True, "good")
    if any(b.label == "good" for b in inside):
        for b in outside:
            b.label = "bad"
    label_by_neighbours(outside, False, "good")
    return "\n".join(b.text for b in found if b.label == "good")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars.

    A null or empty page, and one without main text, has an empty text. Rows stay as they are, repeated ones too, with
    null ids and urls. Pages of any length are read whole, in time that grows with their length. Empty table: no rows.
    Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

"""The main text of a page by nesting and link density, in built-in expressions.

A page is cut into tags and runs of text. One fold over them keeps a stack of the open elements, a letter each, in upper
case where an element is boilerplate by its name or its class, and writes one letter a token: what the token is, and
where it stands. Tokens and letters together give blocks of text with their links marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import plain, word_count
from pagewright.functions.urls import url_host
from pagewright.operators.parse import without_scripts

#: Elements whose nesting is followed, with their letters; those of the second kind are boilerplate always.
NESTED = {"div": "d", "section": "s", "ul": "u", "ol": "o", "article": "r", "main": "i", "span": "p", "table": "t"}
BOILERPLATE = {"nav": "N", "footer": "F", "aside": "A", "header": "H", "form": "M", "noscript": "C", "dialog": "L", "button": "B", "select": "E"}
#: Words of class and id that make any followed element boilerplate.
HINTS = r"\b(ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|cookie|cookies|consent|sidebar|menu|navbar|breadcrumb|breadcrumbs|comment|comments|share|social|related|newsletter|popup|modal|widget)\b"
#: Inline elements; every other tag ends a block.
INLINE = "a|abbr|b|bdi|bdo|big|cite|code|data|dfn|em|font|i|img|ins|del|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr|br"
#: Marks between pieces: end of block, start and end of a link, text inside and outside an article.
END, LINK, UNLINK, INSIDE, OUTSIDE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
#: Share of a block that links may take, inside and outside articles; words a block outside needs.
LINKED_INSIDE, LINKED, WORDS = 0.5, 0.2, 5


def _letter(name: Column, tag: Column) -> Column:
    """The letter of a tag's element, empty if its nesting isn't followed."""
    hinted = F.lower(F.regexp_extract(tag, r"(?i)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)).rlike(HINTS.replace(r"\b", r"(?:\b|_)"))
    out = F.when(name == "", F.lit(""))
    for n, letter in NESTED.items():
        out = out.when(name == n, F.when(hinted, F.lit(letter.upper())).otherwise(F.lit(letter)))
    for n, letter in BOILERPLATE.items():
        out = out.when(name == n, F.lit(letter))
    return out.otherwise(F.lit(""))


def _letters(tokens: Column) -> Column:
    """One letter a token: x text of boilerplate, 1 text inside an article, 2 other text, l and k the start and end of a
    link, b the end of a block, - any other tag."""

    def step(state: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        is_tag, closes, empty = token.rlike("^<[A-Za-z/!]"), token.startswith("</"), token.endswith("/>")
        letter = _letter(name, token)
        both = F.concat(F.lower(letter), F.upper(letter))
        # an end tag closes the last open element of its kind and what is open inside; a stray one nothing
        popped = F.regexp_replace(state["open"], F.concat(F.lit("["), both, F.lit("][^"), both, F.lit("]*$")), F.lit(""))
        stack = F.when(letter == "", state["open"]).when(closes, popped).when(empty, state["open"]).otherwise(F.concat(state["open"], letter))
        text = F.when(state["open"].rlike("[A-Z]"), "x").when(state["open"].rlike("[ri]"), "1").otherwise("2")
        tag = F.when(name == "a", F.when(closes, "k").otherwise("l")).when(name.rlike(f"^({INLINE})$"), "-").otherwise("b")
        return F.struct(stack.alias("open"), F.concat(state["out"], F.when(is_tag, tag).otherwise(text)).alias("out"))

    return F.aggregate(tokens, F.struct(F.lit("").alias("open"), F.lit("").alias("out")), step, lambda s: s["out"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, site, main_text, words, blocks).

    Blocks in an article or main element count if links take up to half of them; if there are none, blocks outside of
    five words and more in which links take up to a fifth. Blocks are joined by line ends. A null or empty page, and one
    without main text, has an empty text of 0 words. No row is dropped and nothing is shuffled.
    """
    html = F.translate(F.coalesce("html", F.lit("")), END + LINK + UNLINK + INSIDE + OUTSIDE, "")
    bare = F.regexp_replace(without_scripts(F.regexp_replace(html, r"(?s)<!--.*?-->", " ")), r"(?is)<(head|title|svg|textarea)\b[^>]*>.*?</\1>", " ")
    rows = pages.select("page_id", url_host(F.col("url")).alias("site"), F.regexp_extract_all(bare, F.lit("<[A-Za-z/!][^>]*>|<|[^<]+"), F.lit(0)).alias("tokens"))
    rows = rows.withColumn("letters", F.split(_letters(F.col("tokens")), ""))
    mark = lambda t, k: (
        F.when(k == "b", END).when(k == "l", LINK).when(k == "k", UNLINK).when(k == "1", F.concat(F.lit(INSIDE), t)).when(k == "2", F.concat(F.lit(OUTSIDE), t)).when(t.rlike("(?i)^<br"), " ").otherwise("")
    )
    rows = rows.withColumn("pieces", F.split(F.array_join(F.zip_with("tokens", "letters", mark), ""), END))

    def block(piece: Column) -> Column:
        text = plain(F.translate(piece, LINK + UNLINK + INSIDE + OUTSIDE, ""))
        own = plain(F.translate(F.regexp_replace(piece, f"{LINK}[^{UNLINK}]*{UNLINK}?", ""), UNLINK + INSIDE + OUTSIDE, ""))
        return F.struct(text.alias("text"), piece.contains(INSIDE).alias("inside"), (1 - F.length(own) / F.greatest(F.length(text), F.lit(1))).alias("linked"))

    rows = rows.withColumn("found", F.filter(F.transform("pieces", block), lambda b: b["text"] != ""))
    inside = F.filter("found", lambda b: b["inside"] & (b["linked"] <= LINKED_INSIDE))
    outside = F.filter("found", lambda b: ~b["inside"] & (b["linked"] <= LINKED) & (word_count(b["text"]) >= WORDS))
    rows = rows.withColumn("kept", F.when(F.size(inside) > 0, inside).otherwise(outside))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    words = F.aggregate("kept", F.lit(0), lambda n, b: n + word_count(b["text"]))
    return rows.select("page_id", "site", text.alias("main_text"), words.alias("words"), F.size("kept").alias("blocks"))

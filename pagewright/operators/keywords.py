"""Keyword analytics: phrases by place, focus keywords, and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import clamp_0_100, normalize_text, simple_stem
from pagewright.functions.urls import is_internal, path_segments, url_path
from pagewright.operators.flags import infer_page_type, product_cards
from pagewright.sources.shared import written

#: Words that don't count inside phrases, and words that make no keyword alone.
STOPWORDS = (
    "you your and the a an of to for with in on at by we our us they them it is are be this that these those has he its was will have had what said each which their "
    "time if up out many then so some her would make like into him two more very after words long than first been call who oil sit now find down day did get come made may part"
).split()
GENERIC = "company support service services solutions products product team group systems business".split()
#: Words that make no keyword by themselves in version 2.
GENERIC_BUSINESS = "company platform service services solution solutions product products tools tool support systems business team".split()
WEIGHTS = {"title": 10, "h1": 8, "h2": 6, "slug": 5, "nav": 7}


#: What a page counts by its type in version 2.
PAGE_WEIGHTS = {"home": 3.0, "landing": 2.5, "product": 2.0, "catalog": 2.0, "article": 1.0, "generic": 0.5, "contact": 0.5, "utility": 0.0, "media_gallery": 0.5}


def runs_of(words: Column, n: int) -> Column:
    """All runs of ``n`` words, for arrays of that length at least."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.slice(words, i, F.lit(n)))


def phrases(words: Column) -> Column:
    """Phrases of windows of 2 and 3 words, stopwords dropped inside the window: two words at least left,
    four characters, not digits alone."""
    windows = [F.when(F.size(words) >= n, runs_of(words, n)).otherwise(F.array().cast("array<array<string>>")) for n in (2, 3)]
    cut = F.transform(F.concat(*windows), lambda w: F.filter(w, lambda x: ~x.isin(STOPWORDS)))
    joined = F.transform(F.filter(cut, lambda w: F.size(w) >= 2), lambda w: F.array_join(w, " "))
    return F.filter(joined, lambda p: (F.length(p) >= 4) & ~p.rlike("^[0-9 ]+$"))


def slug(url: Column) -> Column:
    """The last path segment without its extension."""
    return F.regexp_replace(F.coalesce(F.try_element_at(path_segments(url), F.lit(-1)), F.lit("")), r"\.[A-Za-z0-9]+$", "")


def located_phrases(parsed: DataFrame) -> DataFrame:
    """(site, url, place, phrase) from title, h1, h2, slug and nav."""
    texts = lambda tag: F.transform(F.filter("headings", lambda h: h["tag"] == tag), lambda h: h["text"])
    places = F.array(*[F.struct(F.lit(p).alias("place"), t.alias("texts")) for p, t in (("title", F.array("title")), ("h1", texts("h1")), ("h2", texts("h2")), ("slug", F.array(slug(F.col("url")))), ("nav", F.col("nav_labels")))])
    rows = parsed.select("site", "url", F.explode(places).alias("p")).select("site", "url", "p.place", F.explode("p.texts").alias("text"))
    return rows.select("site", "url", "place", F.explode(phrases(F.split(normalize_text(F.col("text")), " "))).alias("phrase"))


def phrase_scores(parsed: DataFrame) -> DataFrame:
    """Weight per occurrence by place; +3 on two or more pages, +2 in a title or heading, +1 for three words."""
    weight = F.coalesce(*[F.when(F.col("place") == p, F.lit(w)) for p, w in WEIGHTS.items()])
    rows = located_phrases(parsed).groupBy("site", "phrase").agg(F.sum(weight).alias("weight"), F.count_distinct("url").alias("pages"), F.max(F.col("place").isin("title", "h1", "h2").cast("int")).alias("headed"))
    extra = F.when(F.col("pages") >= 2, 3).otherwise(0) + 2 * F.col("headed") + F.when(F.size(F.split("phrase", " ")) == 3, 1).otherwise(0)
    return rows.select("site", "phrase", "pages", (F.col("weight") + extra).alias("score"))


def phrase_scores_v2(parsed: DataFrame) -> DataFrame:
    """Occurrences anywhere plus twice those in titles, headings and navigation; phrases of generic words only go."""
    rows = located_phrases(parsed).where(F.size(F.array_except(F.split("phrase", " "), F.array(*map(F.lit, GENERIC_BUSINESS)))) > 0)
    rows = rows.groupBy("site", "phrase").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("place") != "slug").alias("important"), F.count_distinct("url").alias("pages"))
    return rows.withColumn("score", 2 * F.col("important") + F.col("occurrences"))


def single_word_scores(parsed: DataFrame) -> DataFrame:
    """Stems of words over two letters in titles (3), h1 (2) and h2 (1); stopwords and generic stems don't count."""
    part = lambda tag: F.transform(F.filter("headings", lambda h: h["tag"] == tag), lambda h: h["text"])
    places = F.array(*[F.struct(F.lit(w).alias("weight"), t.alias("texts")) for w, t in ((3, F.array("title")), (2, part("h1")), (1, part("h2")))])
    rows = parsed.select("site", F.explode(places).alias("p")).select("site", "p.weight", F.explode("p.texts").alias("text"))
    rows = rows.select("site", "weight", F.explode(F.split(normalize_text(F.col("text")), " ")).alias("w")).where((F.length("w") > 2) & ~F.col("w").isin(STOPWORDS))
    return rows.select("site", "weight", simple_stem(F.col("w")).alias("word")).where(~F.col("word").isin(GENERIC)).groupBy("site", "word").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("occurrences"))


def focus_keywords(parsed: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` keywords of each site: its phrases by score, pages and name, and where they are fewer than ``k``, single
    words behind them, with 0 pages. Words compete among the site's 2 ``k`` best; short ones and numbers make none."""
    best = Window.partitionBy("site").orderBy(F.desc("score"), "phrase")
    words = single_word_scores(parsed).select("site", F.col("word").alias("phrase"), F.lit(0).cast("bigint").alias("pages"), "score", F.lit(1).alias("single"))
    words = words.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * k).drop("r").where((F.length("phrase") >= 3) & ~F.col("phrase").rlike("^[0-9]+$"))
    order = Window.partitionBy("site").orderBy("single", F.desc("score"), F.desc("pages"), "phrase")
    both = phrase_scores(parsed).withColumn("single", F.lit(0)).unionByName(words)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("single")


def density_score(percent: Column) -> Column:
    return (
        F.when(percent < 0.5, percent / 0.5 * 50).when(percent < 1.5, 50 + (percent - 0.5) * 50).when(percent < 2.5, 100 - (percent - 1.5) * 20).when(percent < 5, 80 - (percent - 2.5) / 2.5 * 80).otherwise(0.0)
    )


def _heads(tag: str) -> Column:
    return F.transform(F.filter("headings", lambda h: h["tag"] == tag), lambda h: h["text"])


def page_places() -> dict[str, Column]:
    """The texts of a parsed page by the place they stand in."""
    anchors = F.transform(F.filter("links", lambda x: is_internal(x["href"], F.col("url"))), lambda x: x["label"])
    return {"text": F.array("text"), "title": F.array("title"), "h1": _heads("h1"), "h2": _heads("h2"), "slug": F.array(slug(F.col("url"))), "anchor": anchors}


def tokens(text: Column) -> Column:
    """Words that count for density: three letters and more, no stopword; at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(normalize_text(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))))


def phrase_lists(wanted: DataFrame, most: int = 100) -> DataFrame:
    """``wanted(site, phrase)``, each once -> (site, part, phrases): the phrases of a site in lists of about ``most``, each
    with its words between blanks of their own, as ``phrase_hits`` looks for them."""
    parts = wanted.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    spaced = F.concat(F.lit(" "), F.replace("phrase", F.lit(" "), F.lit("  ")), F.lit(" "))
    rows = wanted.where("phrase <> ''").join(parts, "site").withColumn("part", F.pmod(F.xxhash64("phrase"), F.col("parts")))
    return rows.groupBy("site", "part").agg(F.collect_list(F.struct("phrase", spaced.alias("spaced"))).alias("phrases"))


def phrase_hits(pages: DataFrame, wanted: DataFrame, texts: dict[str, Column], *keep: str) -> DataFrame:
    """(site, phrase, url, *keep, place, n): how often phrases stand in each place of a page. Every page meets the phrases of
    its site, and a text is searched for each of them, so that only what was found is a row of its own. Places that
    overlap, as a phrase that ends as it begins can have, count from left to right, each word once."""
    places = F.array(*[F.struct(F.lit(p).alias("place"), t.alias("texts")) for p, t in texts.items()])
    met = pages.select("site", "url", *keep, places.alias("places")).join(written(phrase_lists(wanted), "phrases"), "site")
    met = met.select("site", "url", *keep, "phrases", F.explode("places").alias("p")).select("site", "url", *keep, "phrases", "p.place", F.explode("p.texts").alias("t"))
    # a blank on either side of every word: neighbouring places share no blank, so replacing takes each
    met = met.withColumn("t", F.concat(F.lit(" "), F.replace(normalize_text(F.col("t")), F.lit(" "), F.lit("  ")), F.lit(" ")))
    left = lambda p: F.octet_length(F.replace("t", p["spaced"], F.lit("")))
    times = lambda p: ((F.octet_length("t") - left(p)) / F.octet_length(p["spaced"])).cast("bigint")
    found = F.transform(F.filter("phrases", lambda p: F.contains(F.col("t"), p["spaced"])), lambda p: F.struct(p["phrase"].alias("phrase"), times(p).alias("n")))
    met = met.select("site", "url", *keep, "place", F.explode(found).alias("f")).select("site", "url", *keep, "place", "f.*")
    return met.groupBy("site", "phrase", "url", *keep, "place").agg(F.sum("n").alias("n"))


def keyword_metrics(parsed: DataFrame, keywords: DataFrame) -> DataFrame:
    """``keywords(site, phrase)`` against every page of their site: pages whose text holds the phrase,
    occurrences there, pages by place, coverage, on-page, density and total score.

    Coverage is the share of pages used, on-page the weighted shares of all pages whose title, h1, h2, slug or internal
    anchors hold the phrase (fixed values: the weights), density the mean over used pages of occurrences by words that
    count. A phrase that no text holds scores 0 throughout; total is rounded to one digit.
    """
    wanted = written(keywords.select("site", "phrase").distinct(), "keywords")  # read twice, and its size is known
    met = phrase_hits(parsed.withColumn("tokens", tokens(F.col("text"))), wanted, page_places(), "tokens")
    at = lambda p: F.col("place") == p
    shares = {"title": 0.30, "h1": 0.20, "h2": 0.20, "slug": 0.15, "anchor": 0.15}
    facts = met.groupBy("site", "phrase").agg(
        F.count_if(at("text")).alias("pages_used"), F.sum(F.when(at("text"), F.col("n")).otherwise(0)).alias("occurrences"), *[F.count_if(at(p)).alias(f"{p}_pages") for p in shares],
        F.avg(F.when(at("text"), F.col("n") * 100 / F.col("tokens"))).alias("density"),
    )
    total = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("all_pages"))
    rows = wanted.join(facts, ["site", "phrase"], "left").join(total, "site").na.fill(0)
    used, pages = F.col("pages_used") > 0, F.col("all_pages")
    score = lambda c: F.when(used, c).otherwise(0.0)
    on_page = sum((F.least(F.lit(1.0), F.col(f"{p}_pages") / pages) * (100 * s) for p, s in shares.items()), F.lit(0.0))
    rows = rows.withColumns({"coverage": score(100 * F.col("pages_used") / pages), "on_page": score(clamp_0_100(on_page)), "density_score": score(clamp_0_100(density_score(F.col("density"))))})
    return rows.withColumn("total", F.bround(0.3 * F.col("coverage") + 0.4 * F.col("on_page") + 0.3 * F.col("density_score"), 1)).drop("all_pages")


def keyword_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("site").agg(F.avg("total").alias("overall"), F.count_if(F.col("pages_used") > 0).alias("used"), F.count(F.lit(1)).alias("keywords"))


def keyword_metrics_v2(parsed: DataFrame, keywords: DataFrame) -> DataFrame:
    """``keywords(site, phrase)`` on the pages of their site, which count by their type.

    Coverage is the weight of pages whose text holds the phrase, on-page whether any title, h1, h2, slug or anchor
    does, total .6 coverage + .3 on-page + .1 density; a phrase that no text holds scores 0. Importance is 3 in a home
    page's title or navigation, 2 in a title or h1 of a landing, product or catalog page, else 1.
    """
    home = F.lower(F.regexp_replace(url_path(F.col("url")), "^/+|/+$", "")).isin("", "index", "index.html", "home")
    kind = infer_page_type(F.col("url"), F.col("words"), F.size("paragraphs"), F.size("headings"), product_cards(F.col("n_images"), F.col("n_internal")))
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in PAGE_WEIGHTS.items()], F.lit(1.0))
    pages = parsed.withColumn("kind", F.when(home, "home").otherwise(kind)).withColumn("weight", weight).withColumn("tokens", tokens(F.col("text")))
    wanted = written(keywords.select("site", "phrase").distinct(), "keywords")  # read twice, and its size is known
    met = phrase_hits(pages, wanted, page_places() | {"nav": F.col("nav_labels")}, "kind", "weight", "tokens")
    at = lambda *places: F.col("place").isin(*places)
    hits = [F.count_if(at(p)).alias(f"{p}_pages") for p in ("title", "h1", "h2", "slug", "anchor")]
    facts = met.groupBy("site", "phrase").agg(
        F.count_if(at("text")).alias("pages_used"), F.sum(F.when(at("text"), F.col("n")).otherwise(0)).alias("occurrences"), F.sum(F.when(at("text"), F.col("weight")).otherwise(0.0)).alias("weighted_pages"), *hits,
        F.avg(F.when(at("text"), F.col("n") / F.col("tokens"))).alias("density"),
        F.max(F.when((F.col("kind") == "home") & at("title", "nav"), 3.0).when(F.col("kind").isin("landing", "product", "catalog") & at("title", "h1"), 2.0).otherwise(1.0)).alias("importance"),
    )
    total = pages.groupBy("site").agg(F.sum("weight").alias("all_weight"))
    rows = wanted.join(facts, ["site", "phrase"], "left").join(total, "site").withColumn("importance", F.coalesce("importance", F.lit(1.0))).na.fill(0)
    shares = {"title": 0.40, "h1": 0.25, "h2": 0.15, "slug": 0.10, "anchor": 0.10}
    used = (F.col("pages_used") > 0) & (F.col("weighted_pages") > 0)
    coverage = 100 * F.col("weighted_pages") / F.greatest(F.col("all_weight"), F.lit(1.0))
    on_page = sum((F.when(F.col(f"{p}_pages") > 0, 100 * s).otherwise(0.0) for p, s in shares.items()), F.lit(0.0))
    density = F.when(F.col("density") <= 0, 0.0).when(F.col("density") < 0.001, 20.0).when(F.col("density") > 0.03, 40.0).otherwise(80.0)
    rows = rows.withColumn("coverage", F.when(used, coverage).otherwise(0.0)).withColumn("on_page", F.when(used, on_page).otherwise(0.0)).withColumn("density_score", F.when(used, density).otherwise(0.0))
    return rows.withColumn("total", F.bround(0.6 * F.col("coverage") + 0.3 * F.col("on_page") + 0.1 * F.col("density_score"), 1)).drop("all_weight")


def keyword_summary_v2(metrics: DataFrame) -> DataFrame:
    """Mean total by importance, of each site."""
    return metrics.groupBy("site").agg((F.sum(F.col("total") * F.col("importance")) / F.sum("importance")).alias("overall"), F.count_if(F.col("pages_used") > 0).alias("used"), F.count(F.lit(1)).alias("keywords"))


def keyword_comparison(parsed: DataFrame, primary: str, k: int = 20) -> DataFrame:
    """(site, phrase, total): the ``k`` focus keywords of one site scored on every site, 0 where unused."""
    top = [r["phrase"] for r in focus_keywords(parsed.where(F.col("site") == primary), k).orderBy("rank").collect()]  # k rows at most
    wanted = parsed.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, top)).cast("array<string>")).alias("phrase"))
    return keyword_metrics(parsed, wanted).select("site", "phrase", "total")

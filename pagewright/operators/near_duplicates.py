"""Near-duplicate texts of a site by SimHash: every pair within a Hamming distance, the greedy choice in order, and the
share of unique pages.

Texts of one fingerprint form a class, which its smallest id stands for; pairs are between classes. For all pairs a site
is dealt into parts, and every two parts are a group of their own that is compared in numpy, so no site is one task's work.
The parts are as many as the square root of the site's size asks for: what is copied to groups then grows far slower than
the pairs. Where only some classes are compared with the rest, the 64 bits are cut into one block more than bits may
differ, so that two fingerprints in reach agree on a block; site, block and the block's value are that join's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagewright.functions.simhash import pairs_within, signed, simhash_of_words, words
from pagewright.sources.shared import written

#: Bits of 64 in which near duplicates differ at most: a similarity of 0.8.
WITHIN = 12
#: Classes of a site that are compared in one piece; a site of k * k times as many is dealt into k parts.
PIECE = 1_024
#: Classes at the head of a site that the greedy choice decides first.
CELL = 4_096


def block_masks(within: int = WITHIN) -> list[int]:
    """64 bits cut into ``within`` + 1 blocks, as even as they get, as masks."""
    n, out, low = within + 1, [], 0
    for i in range(n):
        high = 64 * (i + 1) // n
        out.append(signed(((1 << high) - 1) ^ ((1 << low) - 1)))
        low = high
    return out


def fingerprints(texts: DataFrame) -> DataFrame:
    """``texts(site, id, text)`` -> (site, id, simhash). Null and empty texts have no fingerprint and no row; a text
    without a word has fingerprint 0."""
    rows = texts.where("text <> ''").select("site", "id", words(F.col("text")).alias("words"))
    schema = StructType([*rows.schema.fields[:2], StructField("simhash", LongType())])
    return rows.mapInArrow(simhash_of_words, schema)


def classes(prints: DataFrame) -> DataFrame:
    """(site, simhash, first, members): the smallest id of each fingerprint of a site, and its rows."""
    return prints.groupBy("site", "simhash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"))


def near_duplicate_members(prints: DataFrame) -> DataFrame:
    """(site, id, first): the class of every row. Classes of any size are joined, never collected."""
    own = classes(prints).select(F.col("site").alias("s"), F.col("simhash").alias("h"), "first")
    return prints.join(own, prints.site.eqNullSafe(F.col("s")) & (prints.simhash == F.col("h"))).select("site", "id", "first")


def near_pairs(own: DataFrame, within: int = WITHIN, cell: int = PIECE) -> DataFrame:
    """``classes`` -> (site, a, b, distance) with a < b: every two classes of a site whose fingerprints differ in at most
    ``within`` bits. A null site is a site. No pair is lost to a site's size."""
    rows = written(own.where("first is not null").select("site", "first", "simhash"), "classes")
    large = rows.groupBy(F.col("site").alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    large = large.select("s", F.ceil(F.sqrt(F.col("n") / cell)).cast("int").alias("parts"))  # one row for ``cell`` classes at most
    rows = rows.join(F.broadcast(large), rows.site.eqNullSafe(F.col("s")), "left").drop("s").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int"))
    rows = rows.select("site", "first", "simhash", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("site", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "first", "simhash")
    # the number is given, as small groups have large results and must not be put together by their size
    rows = rows.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site", "low", "high")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("site", kinds["site"]), StructField("a", kinds["first"]), StructField("b", kinds["first"]), StructField("distance", IntegerType())])
    return rows.groupBy("site", "low", "high").applyInArrow(pairs_within(within), schema)


def near_duplicate_pairs(prints: DataFrame, within: int = WITHIN) -> DataFrame:
    return near_pairs(classes(prints), within)


def _chosen(head: DataFrame, within: int) -> DataFrame:
    """Of classes ``head(site, first, simhash)`` those that the greedy choice keeps, as (site, first, simhash).

    Rounds instead of a scan: an undecided class without an undecided neighbour before it is kept, and all its later
    neighbours go. Only undecided pairs enter the next round. Ends for any order: the first undecided class of a site is
    decided in every round.
    """
    left = written(near_pairs(head, within).select("site", "a", "b"), "undecided")
    gone = left.select("site", F.col("b").alias("id")).limit(0)
    while not left.isEmpty():
        waits = left.select(F.col("site").alias("s"), F.col("b").alias("w")).distinct()
        kept = left.join(waits, left.site.eqNullSafe(F.col("s")) & (left.a == F.col("w")), "left_anti")
        new = written(kept.select("site", F.col("b").alias("id")).distinct(), "dropped")
        n = new.select(F.col("site").alias("s"), F.col("id").alias("d"))
        # what a kept class drops takes its pairs with it, and with them all pairs of the class that dropped it
        rest = left.join(n, left.site.eqNullSafe(F.col("s")) & (left.b == F.col("d")), "left_anti")
        rest = rest.join(n, rest.site.eqNullSafe(F.col("s")) & (rest.a == F.col("d")), "left_anti")
        left, gone = written(rest, "undecided"), gone.unionByName(new)
    g = gone.select(F.col("site").alias("s"), F.col("id").alias("d"))
    return head.join(g, head.site.eqNullSafe(F.col("s")) & (head["first"] == F.col("d")), "left_anti")


def _heads(left: DataFrame, size: int) -> DataFrame:
    """(s, upto): up to which id the first classes of each site reach, about ``size`` of them, one at least. Ids are cut by
    approximate quantiles, so no site is sorted; any cut gives the same choice."""
    halves = 30
    shares = F.percentile_approx("first", [0.5**i for i in range(halves)], 100_000)
    cut = left.groupBy(F.col("site").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("all"), shares.alias("q"))
    nth = F.least(F.ceil(F.log2(F.col("n") / size)), F.lit(halves - 1)).cast("int") + 1
    return cut.select("s", F.when(F.col("n") <= size, F.col("all")).otherwise(F.element_at("q", nth)).alias("upto"))


def _in_reach(rows: DataFrame, kept: DataFrame, within: int) -> DataFrame:
    """Of ``rows`` those within reach of a kept class of their site, as (s, d)."""
    masks = block_masks(within)
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("block"), F.col("simhash").bitwiseAND(F.lit(m)).alias("value")) for j, m in enumerate(masks)]))
    keyed = lambda df: df.select("site", "first", "simhash", each.alias("b")).select("site", "first", "simhash", "b.*")
    left, right = keyed(rows), keyed(kept).select(*[F.col(c).alias(f"k_{c}") for c in ("site", "block", "value", "simhash")])
    same = left.site.eqNullSafe(F.col("k_site")) & (left.block == F.col("k_block")) & (left.value == F.col("k_value"))
    near = left.join(right, same & (F.bit_count(left.simhash.bitwiseXOR(F.col("k_simhash"))) <= within), "left_semi")
    return near.select(F.col("site").alias("s"), F.col("first").alias("d")).distinct()


def dedup_greedy(prints: DataFrame, within: int = WITHIN, head: int = CELL) -> DataFrame:
    """(site, id, kept): in order of id a text is kept if no kept one before it is in reach, as a scan would choose.

    The first ``head`` undecided classes of each site are decided among themselves; the kept ones of them drop what is in
    their reach of all that follow, and twice as many of the rest come next. So pairs are made among the classes at the
    head and with kept classes only, never among all texts in reach of each other. Rows of a class but its first go.
    """
    left = written(classes(prints).select("site", "first", "simhash"), "classes")
    kept = left.select("site", "first").limit(0)
    while not left.isEmpty():
        cut = written(_heads(left, head), "heads")
        placed = left.join(cut, left.site.eqNullSafe(F.col("s")))
        now = written(placed.where("first <= upto").select("site", "first", "simhash"), "head")
        chosen = written(_chosen(now, within), "kept")
        rest = written(placed.where("first > upto").select("site", "first", "simhash"), "rest")
        near = _in_reach(rest, chosen, within)
        left = written(rest.join(near, rest.site.eqNullSafe(F.col("s")) & (rest["first"] == F.col("d")), "left_anti"), "classes")
        kept, head = kept.unionByName(chosen.select("site", "first")), 2 * head
    decided = kept.select(F.col("site").alias("f_site"), "first")
    rows = prints.join(decided, prints.site.eqNullSafe(F.col("f_site")) & (prints.id == F.col("first")), "left")
    return rows.select("site", "id", F.col("first").isNotNull().alias("kept"))


def page_content(parsed: DataFrame) -> DataFrame:
    """What of a page is compared, as (site, id, text): the title and the first 1,000 characters of its text."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.left(F.coalesce("text", F.lit("")), F.lit(1000)))
    return parsed.select("site", F.col("page_id").alias("id"), text.alias("text")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")


def unique_content_ratio(prints: DataFrame, within: int = WITHIN) -> DataFrame:
    """(site, pages, unique_pages, unique_ratio): a page is unique if no page of its site before it, by id, is in reach.
    Sites without any fingerprint have no row."""
    own = classes(prints)
    later = near_pairs(own, within).select(F.col("site").alias("s"), F.col("b").alias("l")).distinct()
    rows = own.join(later, own.site.eqNullSafe(F.col("s")) & (F.col("first") == F.col("l")), "left")
    out = rows.groupBy("site").agg(F.sum("members").alias("pages"), F.count_if(F.col("l").isNull()).alias("unique_pages"))
    return out.withColumn("unique_ratio", F.col("unique_pages") / F.col("pages") * 100)

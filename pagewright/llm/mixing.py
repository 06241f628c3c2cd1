"""Mixing sources to target weights with Efraimidis-Spirakis keys.

A source's target is a share of all words by its weight, three times its own words at most, what is over being
shared anew. A source gives as many complete epochs as its target holds; the rest is a weighted sample
without replacement: each document draws an exponential key over its quality, and documents are taken in the
order of the keys until the budget is full. The order is walked in three steps, so that no source's documents
meet in one task: words are summed by sixteenths of a doubling of the key and prefix-summed, then those of the part
in which the budget ends once more by ``FINE`` sub-parts, whatever the qualities; only the sub-part in which it
ends is walked document by document, copies as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, free_name, saved, table

#: Parts of a doubling of the key, and sub-parts of a part.
COARSE, FINE = 16, 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), BLANKS)
    # only the ends can be empty
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (F.size(words) - ends).cast("bigint")


def quality(text: Column, words: Column) -> Column:
    """Weight in [0.05, 1]: full for words of 3 to 9 characters on average, less the farther from that; and full where a
    fifth of the words are different ones, less in proportion where they repeat more."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    mean = F.length(whole) / F.greatest(words, F.lit(1)) - 1
    off = F.greatest(F.lit(3.0) - mean, mean - F.lit(9.0), F.lit(0.0))
    varied = 5.0 * F.size(F.array_distinct(F.split(whole, BLANKS))) / F.greatest(words, F.lit(1))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), varied) / (1 + off))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> ``(goal, source_size, target)``, goal the source. Sources by code point, null
    last, weigh 1, 2, 3, repeating. A level common to all uncapped sources makes the targets' sum the sum of
    the sizes; it is found in the order in which sources reach their cap."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # these windows run over one row per source
    w = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("n") % len(weights) + 1).cast("double"))
    caps = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    stepped = caps.withColumn("level", level)
    # the first source whose cap lies above the level there is the first that stays uncapped
    ranked = stepped.withColumn("r", F.row_number().over(by)).withColumn("s", F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("r", "level")))
    chosen = F.min("s").over(everything)["level"]
    return ranked.withColumn("chosen", chosen).select(F.col("source").alias("goal"), "source_size", F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("chosen") * F.col("w"))).alias("target"))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with its columns ``keep``, and the columns that the mix adds, under free names: source_size,
    target, size, times (how often the row is taken whole) and extra (the words taken beyond complete epochs)."""
    names = {n: free_name(docs, f"_{n}") for n in ("size", "key", "bin", "sub", "src", "rid", "part", "source_size", "target", "epochs", "budget", "last", "before", "fine", "start", "n", "times", "extra", "quality")}
    c = {k: F.col(v) for k, v in names.items()}
    # a copy has its original's key: the id and the text decide, not the place
    seen = F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")).cast("string"))
    u = (F.conv(F.substring(F.md5(seen), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    scaled = F.log2(c["key"]) * COARSE
    # a source as a key that is never null
    keyed = (
        docs.withColumn(names["size"], word_count(F.col("text")))
        .withColumn(names["quality"], quality(F.col("text"), c["size"]))
        .withColumn(names["key"], -F.log(u) / c["quality"])
        .withColumn(names["src"], F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
        .withColumn(names["bin"], F.floor(scaled).cast("int"))
        .withColumn(names["sub"], F.floor((scaled - F.floor(scaled)) * FINE).cast("int"))
        .withColumn(names["rid"], F.monotonically_increasing_id())
    )
    keyed = saved(keyed.select(*keep, *(names[n] for n in ("src", "size", "key", "bin", "sub", "rid"))), "mixing")
    sums = saved(keyed.groupBy(names["src"], names["bin"]).agg(F.sum(c["size"]).alias(names["n"])), "parts")
    sizes = sums.groupBy(names["src"]).agg(F.sum(c["n"]).alias("source_size"))
    named = sizes.select(F.expr(f"if({names['src']} = 'null', null, substring({names['src']}, 2))").alias("source"), "source_size", names["src"])
    goals = named.select("source", names["src"]).join(targets(named.select("source", "source_size"), weights, most), F.expr("source <=> goal")).drop("source", "goal")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = goals.select(names["src"], F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), epochs.alias(names["epochs"]), (F.col("target") - epochs * F.col("source_size")).alias(names["budget"]))
    goals = saved(goals, "goals")

    def ends_in(part: DataFrame, by: str, base: Column, last: str, before: str) -> DataFrame:
        """The part of each source in which its budget ends, and the words before it."""
        running = base + F.sum(c["n"]).over(Window.partitionBy(names["src"]).orderBy(by))
        span = part.withColumn(before, running - c["n"])
        found = (F.col(before) < c["budget"]) & (F.col(before) + c["n"] >= c["budget"])
        return span.where(found).select(names["src"], F.col(by).alias(last), before)

    marks = saved(ends_in(sums.join(goals, names["src"]), names["bin"], F.lit(0), names["last"], names["before"]), "marks")
    inside = keyed.join(marks, names["src"]).where(c["bin"] == c["last"])
    subs = saved(inside.groupBy(names["src"], names["sub"], names["before"]).agg(F.sum(c["size"]).alias(names["n"])), "sub-parts")
    fine = saved(ends_in(subs.join(goals, names["src"]), names["sub"], c["before"], names["fine"], names["start"]), "sub-marks")
    # one row per source; Spark broadcasts it below its size threshold and else joins by shuffle, splitting hot sources
    whole = saved(goals.join(marks.drop(names["before"]), names["src"], "left").join(fine, names["src"], "left"), "plan")
    rows = keyed.join(whole, names["src"])
    more = F.coalesce(((c["bin"] < c["last"]) | ((c["bin"] == c["last"]) & (c["sub"] < c["fine"]))).cast("int"), F.lit(0))
    ends_here = F.coalesce((c["bin"] == c["last"]) & (c["sub"] == c["fine"]), F.lit(False))
    clear = rows.where(~ends_here).withColumn(names["times"], c["epochs"] + more).withColumn(names["extra"], c["size"] * more)
    # copies count as one, by the task that wrote them, so that a crowd of them is never sorted in one task
    edge = rows.where(ends_here).withColumn(names["part"], F.shiftright(names["rid"], 33))
    same = [names[n] for n in ("src", "key", "size", "part")]
    crowds = edge.groupBy(*same).agg(F.count(F.lit(1)).alias(names["n"]))
    order = Window.partitionBy(names["src"]).orderBy(names["key"], names["size"], names["part"])
    crowds = crowds.withColumn(names["before"], F.sum(c["n"] * c["size"]).over(order) - c["n"] * c["size"]).drop(names["n"])
    upto = c["start"] + c["before"] + c["size"] * F.row_number().over(Window.partitionBy(*same).orderBy(names["rid"]))
    # nearer with than without: the middle of the document lies before the budget's end
    cut = edge.join(crowds, same).withColumn(names["times"], c["epochs"] + ((upto - c["size"] / 2) <= c["budget"]).cast("int"))
    # of the document in which the budget ends its first words are taken, up to the budget in whole words
    part = F.floor(c["budget"] + 0.5) - (upto - c["size"])
    cut = cut.withColumn(names["extra"], F.greatest(F.lit(0), F.least(c["size"], part)))
    out = [*keep, *(names[n] for n in ("size", "source_size", "target", "epochs", "times", "extra"))]
    return clear.select(*out).union(cut.select(*out)), names


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``(doc_id, size, source_size, target, taken)``, one row per input row, and
    ``source`` and ``times``.

    ``taken`` is the words that the mix takes of the document: its size by the source's complete epochs, once more if its
    key comes before the budget is full, and its first words only if the budget ends in it; so a source's words are its
    target rounded to whole words. ``times`` is how often it comes as a whole document, the last one if that is nearer
    to the target. Null and empty texts have size 0 and are taken
    as 0 words; a long text is a document like any other. A null source is a source of its own, the last. Repeated
    rows have one key and are taken one by one. A corpus without words gives targets of 0. Empty table: no
    rows. Extra columns are left out. Sources themselves, one row each, are ranked in one task.
    """
    rows, n = _plan(docs.select("doc_id", "text", "source"), weights, most, ["doc_id", "source"])
    col = lambda k: F.col(n[k]).alias(k)
    return rows.select("doc_id", col("size"), col("source_size"), col("target"), (F.col(n["size"]) * F.col(n["epochs"]) + F.col(n["extra"])).alias("taken"), "source", col("times"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` as the mix takes them, in whole documents: each row as often as ``times`` of ``mix`` says; columns and their order as they were,
    whatever their names. Rows without words come with their source's complete epochs or not at all. Repeated rows
    and null ids are rows of their own. Empty table: no rows."""
    rows, n = _plan(docs, weights, most, docs.columns)
    copy = free_name(rows, "_copy")
    return rows.where(F.col(n["times"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n["times"]).cast("int")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

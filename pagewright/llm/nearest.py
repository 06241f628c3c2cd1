"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Centroids of the lists are fitted on a bounded sample; every vector is filed. A query scans the lists
nearest to it. Inside a list, vectors are turned by a random rotation and read in blocks of columns: after
each block a hypothesis test on the partial distance abandons candidates that are, almost surely, farther
than the query's current k-th. How many lists to probe is measured, not guessed: the least number that holds
``aim`` of the sample's own true neighbours. Queries for which the probed lists hold too few rows scan all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import as_doubles, unit_rows, usable

#: Vectors that the index is fitted on, at most.
SAMPLE = 20_000
#: Column blocks and the strictness of the test: a candidate goes if its scaled partial distance exceeds the bound by a factor 1 + EPSILON / sqrt(columns read).
COLUMNS, EPSILON = 16, 2.1


def fit(sample: np.ndarray, total: int, k: int, aim: float, seed: int = 11) -> tuple[np.ndarray, int]:
    """Centroids of about sqrt(total) lists (a 40th of the sample at most), and how many lists to probe."""
    rng, n = np.random.default_rng(seed), len(sample)
    lists = int(max(1, min(np.ceil(np.sqrt(total)), n // 40)))
    centres = sample[rng.choice(n, lists, replace=False)]
    for _ in range(12):
        at = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1)
        empty = size == 0
        sums[empty], size[empty] = sample[rng.integers(0, n, empty.sum())], 1
        centres = sums / size[:, None]
    at = np.argmax(sample @ centres.T, axis=1)
    tried = rng.choice(n, min(n, 400), replace=False)
    near = sample[tried] @ sample.T
    near[np.arange(len(tried)), tried] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, n - 1)]
    rank = np.argsort(np.argsort(-(sample[tried] @ centres.T), axis=1), axis=1)
    need = np.sort(rank[np.arange(len(tried))[:, None], at[best]].ravel())
    return centres, int(need[min(len(need) - 1, int(np.ceil(aim * len(need))))]) + 1 if len(need) else 1


def scan(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows of ``x`` that may be among the ``k`` nearest of unit vector ``q``; both rotated.

    Rows come in growing batches; the bound is the k-th distance among all rows read to the end so far."""
    first = min(len(x), 4 * k)
    best = ((x[:first] - q) ** 2).sum(1)
    found, at, width = [np.arange(first)], first, x.shape[1]
    while at < len(x):
        alive, part = np.arange(at, min(len(x), 4 * at)), 0.0
        best = np.partition(best, k - 1)[:k]
        bound = best[-1]
        for c in range(0, width, COLUMNS):
            gap = x[alive, c : c + COLUMNS] - q[c : c + COLUMNS]
            part = part + np.einsum("ij,ij->i", gap, gap)
            read = min(c + COLUMNS, width)
            stay = part <= bound + 1e-12 if read == width else part * (width / read) <= bound * (1 + EPSILON / np.sqrt(read)) ** 2 + 1e-12
            alive, part = alive[stay], part[stay]
        found.append(alive)
        best, at = np.concatenate((best, part)), min(len(x), 4 * at)
    return np.concatenate(found)


def _pick(values: np.ndarray, index: str) -> Column:
    """The entry of a fixed array, one per list, that a column names."""
    return F.element_at(F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>"), F.col(index) + 1)


def _search(asked: DataFrame, filed: DataFrame, centres: np.ndarray, probes: int, turn: np.ndarray, sizes: np.ndarray, k: int, block: int) -> DataFrame:
    """``asked(cls, embedding)`` against the ``probes`` lists nearest to each -> ``(q, cls, score)``, k of every piece of a
    list at most. Pieces hold ``block`` candidates at most and are met by ``block`` queries at a time."""

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            lists = np.argsort(-(unit_rows(pdf["embedding"]) @ centres.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(pdf)), lists.shape[1])
            yield pd.DataFrame({"cls": pdf["cls"].to_numpy()[row], "list": lists.ravel()})

    sent = saved(asked.mapInPandas(ask, "cls bigint, list int"), "asked")
    met = np.zeros(len(centres), np.int64)  # one figure per list
    for r in sent.groupBy("list").count().collect():
        met[r["list"]] = r["count"]
    parts, shares = np.maximum(1, -(-sizes // block)), np.maximum(1, -(-met // block))
    queries = (
        sent.withColumn("share", F.pmod(F.xxhash64("cls"), _pick(shares, "list")))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), _pick(parts, "list") - 1)))
        .join(asked, "cls")
    )
    held = (
        filed.where(_pick(met, "list") > 0)
        .withColumn("part", F.pmod(F.xxhash64("cls"), _pick(parts, "list")))
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), _pick(shares, "list") - 1)))
    )

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "cls": [], "score": []})
        qs, xs, ids = unit_rows(q["embedding"]), unit_rows(x["embedding"]), x["least"].to_numpy(dtype=float, na_value=np.inf)
        turned_q, turned_x, out = qs @ turn, xs @ turn, []
        for i in range(len(q)):
            may = scan(turned_q[i], turned_x, min(k + 1, len(x)))
            score = np.clip((xs[may] * qs[i]).sum(1), -1, 1)
            best = np.lexsort((ids[may], -score))[: k + 1]
            out.append((np.full(len(best), q["cls"].iloc[i]), x["cls"].to_numpy()[may[best]], score[best]))
        return pd.DataFrame({c: np.concatenate([o[n] for o in out]) for n, c in enumerate(("q", "cls", "score"))})

    return queries.groupBy("list", "part", "share").cogroup(held.groupBy("list", "part", "share")).applyInPandas(search, "q bigint, cls bigint, score double")


def _of_one_length(good: DataFrame, asked: DataFrame, dims: int, k: int, aim: float, sample: int, block: int, seed: int) -> DataFrame:
    """``good(rid, vec_id, embedding)``, ``asked(rid)`` -> result rows; all vectors have ``dims`` components."""
    order = [F.col("vec_id").asc_nulls_last(), "rid"]
    # a class of equal vectors keeps its k + 1 first rows, which is all that a result can need; Spark cuts before it shuffles
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy(*order))).where(F.col("r") <= k + 1)
    grouped = first.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "rid"))).alias("rows"))
    classes = saved(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    taken = classes.orderBy(F.xxhash64("cls")).limit(sample).select(F.transform("embedding", lambda v: v.cast("double")).alias("embedding")).collect()
    taken = unit_rows(pd.Series([r["embedding"] for r in taken]))
    centres, probes = fit(taken, total, k, aim, seed)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]

    def file(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf[["cls", "embedding", "least"]].assign(list=np.argmax(unit_rows(pdf["embedding"]) @ centres.T, axis=1))

    least = classes.select("cls", "embedding", F.element_at("rows", 1)["vec_id"].alias("least"))
    filed = saved(least.mapInPandas(file, "cls bigint, embedding array<double>, least bigint, list int"), "filed")
    sizes = np.zeros(len(centres), np.int64)  # one figure per list
    for r in filed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    mine = saved(good.join(asked, "rid", "left_semi").join(classes.select("embedding", F.col("cls").alias("q")), "embedding").select("q", "rid", F.col("vec_id").alias("query_id")), "queries")
    vectors = classes.join(mine.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").select("cls", "embedding")

    def answers(which: DataFrame, vectors: DataFrame, probes: int) -> DataFrame:
        hits = _search(vectors, filed, centres, probes, turn, sizes, k, block)
        near = hits.join(classes.select("cls", "rows"), "cls").withColumn("least", F.element_at("rows", 1)["vec_id"])
        top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "cls"))).where(F.col("r") <= k + 1)
        each = which.join(top.select("q", "score", F.explode("rows").alias("x")), "q").where("x.rid <> rid").select("query_id", "rid", "score", "x.vec_id", F.col("x.rid").alias("at"))
        rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "at"))
        return saved(each.withColumn("rank", rank).where(F.col("rank") <= k), "answers")

    found = answers(mine, vectors, probes)
    if probes >= len(centres):
        return found
    # the probed lists may hold fewer than k: those queries scan all lists
    enough = min(k, good.count() - 1)
    full = found.groupBy("rid").count().where(F.col("count") >= enough).select("rid")
    short = saved(mine.join(full, "rid", "left_anti"), "short")
    if short.isEmpty():
        return found
    again = answers(short, vectors.join(short.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi"), len(centres))
    return found.join(short.select("rid"), "rid", "left_anti").unionByName(again)


def nearest(vectors: DataFrame, queries: Column | str, k: int = 5, aim: float = 0.97, sample: int = SAMPLE, block: int = 4096, seed: int = 11) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``: for each row that meets the condition
    ``queries`` the ``k`` nearest other rows by cosine (double precision, original vectors), ties to the smaller id.

    Null, empty, zero or non-finite vectors take no part, as query or candidate. Vectors of different lengths have no
    cosine: each length, of which there are expected to be few, is searched by itself. A row repeating an id is a row of
    its own, as query and as candidate; a null id comes last among ties. A query gets all other rows of its length if
    they are fewer than ``k``. Empty table: no rows. Extra columns are left out.
    """
    usable_rows = vectors.where(usable("embedding")).withColumn("asked", F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False)))
    good = as_doubles(usable_rows.select(F.col("vec_id").cast("bigint"), "embedding", "asked"), "embedding")
    good = saved(good.withColumn("rid", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "vectors")
    found = []
    for r in good.groupBy("dims").agg(F.max("asked").alias("asked")).orderBy("dims").collect():
        if r["asked"]:
            own = good.where(F.col("dims") == r["dims"])
            found.append(_of_one_length(own.select("rid", "vec_id", "embedding"), own.where("asked").select("rid"), r["dims"], k, aim, sample, block, seed))
    result = reduce(DataFrame.unionByName, found) if found else good.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return result.select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")

"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets,
verified pairs.

Equal vectors first fold into one class with a count. A class goes to the bucket of its nearest signed axis
under each of ``hashes`` pseudo-random rotations (sign flips and Hadamard transforms), in each of ``tables``
tables, and to ``probes`` next-nearest buckets; a pair is a candidate where one's own bucket is the other's
own or probed one. All candidates of a bucket are compared by exact cosine. Buckets over ``block`` rows are
dealt out as block pairs, so no task holds more than two blocks and nothing is capped; a vector of a bucket of m rows
travels m / ``block`` times. A pair that meets in
several buckets counts in the first only, so tasks return counts and spanning links rather than pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .components import components
from .vectors import as_doubles, unit_rows, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket (rows, tables) and probed buckets (rows, tables, probes) of unit rows ``x``."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    wide = np.zeros((n, max(2, 1 << (d - 1).bit_length())))
    wide[:, :d] = x
    width = wide.shape[1]
    own, near = np.zeros((n, tables), np.int64), np.zeros((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, moves = np.zeros(n, np.int64), []
        for k in range(hashes):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            both = np.concatenate((y, -y), axis=1)
            kept = min(probes + 1, 2 * width)
            top = np.argpartition(-both, kept - 1, axis=1)[:, :kept]
            score = both[rows[:, None], top]
            order = np.argsort(-score, axis=1, kind="stable")
            top, score = top[rows[:, None], order], score[rows[:, None], order]
            place = (2 * width) ** k
            first += top[:, 0] * place
            # leaving the nearest axis for the j-th costs the squared gap
            moves.append(((score[:, :1] - score[:, 1:]) ** 2, (top[:, 1:] - top[:, :1]) * place))
        cost, change = (np.concatenate(m, axis=1) for m in zip(*moves, strict=True))
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        own[:, t], near[:, t, : best.shape[1]] = first, first[:, None] + change[rows[:, None], best]
    return own, near


def _met(own: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, code: int) -> np.ndarray:
    """Whether pair (i, j) has met before bucket ``code`` of table ``t``."""
    before = np.zeros(len(i), bool)
    for u in range(t + 1):
        same = own[i, u] == own[j, u]
        j_in, i_in = (near[j, u] == own[i, u, None]).any(1), (near[i, u] == own[j, u, None]).any(1)
        if u < t:
            before |= same | j_in | i_in
        else:  # both probe each other's bucket: the smaller one counts
            before |= ~same & j_in & i_in & (np.minimum(own[i, u], own[j, u]) < code)
    return before


def _links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One bucket's pair of blocks -> rows (cls, root, n): links counted here, and a spanning link."""
    t, code, left, right = (int(pdf[c].iloc[0]) for c in ("t", "code", "left", "right"))
    x, home = unit_rows(pdf["embedding"]), pdf["home"].to_numpy()
    own = np.array(pdf["own"].tolist(), np.int64)
    near = np.array(pdf["near"].tolist(), np.int64).reshape(len(pdf), own.shape[1], -1)
    part, copies, cls = pdf["part"].to_numpy(), pdf["copies"].to_numpy(), pdf["cls"].to_numpy()
    a, b = np.flatnonzero(part == left), np.flatnonzero(part == right)
    n, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    found_i, found_j = [], []
    for s in range(0, len(a), 256):
        at = a[s : s + 256]
        i, j = np.nonzero(x[at] @ x[b].T >= threshold)
        i, j = at[i], b[j]
        ok = (i < j) if left == right else np.ones(len(i), bool)
        ok &= home[i] | home[j]
        i, j = i[ok], j[ok]
        new = ~_met(own, near, i, j, t, code)
        i, j = i[new], j[new]
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i or [[]]).astype(int), np.concatenate(found_j or [[]]).astype(int)
    while True:
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (was == root).all():
            break
    hit = n > 0
    return pd.DataFrame({"cls": cls[hit], "root": cls[root[hit]], "n": n[hit]})


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, tables: int = 8, probes: int = 5, block: int = 8192, seed: int = 7
) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    A null, empty or zero vector, or one with a null or non-finite component, links with nothing: 0 links,
    its own component. So do vectors of different lengths. Equal vectors and repeated rows link with each
    other. A null vec_id names a component only if nothing else can; ``kept`` is vec_id <=> component_id.
    Empty table: no rows. Extra columns are left out. The number of rotations per bucket follows the number
    of classes (3 up to 2 million, one more for every factor of 128), and each one more adds ``tables`` tables, so that
    the share of links found stays where it is with 3: at the threshold, one table of 64 components finds 0.64, 0.43
    or 0.29 of them with 3, 4 or 5 rotations, so 8, 16 or 24 tables find 0.9997.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding")
    good = as_doubles(rows.where(usable("embedding")), "embedding")
    classes = saved(
        good.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    total = classes.count()
    hashes = max(3, int(np.ceil(np.log(max(total, 1)) / np.log(128))))
    tables *= hashes - 2

    def deal(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, same in pdf.groupby(pdf["embedding"].map(len)):
                own, near = buckets(unit_rows(same["embedding"]), tables, hashes, probes, seed)
                yield pd.DataFrame({"cls": same["cls"].to_numpy(), "dims": same["embedding"].map(len).to_numpy(), "own": list(own), "near": list(near.reshape(len(same), -1))})

    codes = saved(classes.select("cls", "embedding").mapInPandas(deal, "cls bigint, dims int, own array<bigint>, near array<bigint>"), "codes")
    own = codes.select("cls", "dims", F.posexplode("own").alias("t", "code"), F.lit(True).alias("home"))
    near = codes.select("cls", "dims", F.posexplode("near").alias("at", "code"), F.lit(False).alias("home")).select("cls", "dims", F.expr(f"int(at div {probes})").alias("t"), "code", "home")
    placed = saved(own.union(near), "placed")
    per = placed.groupBy("dims", "t", "code").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("homes")).where("m > 1 and homes > 0")
    parted = (
        placed.join(per.select("dims", "t", "code", F.expr(f"int(ceil(m / {block}))").alias("parts")), ["dims", "t", "code"])
        .withColumn("part", F.expr("int(pmod(xxhash64(cls), parts))"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cls", "dims", "t", "code", "home", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))
    )
    parted = saved(parted, "parted")
    # small buckets share a task's group: about two blocks of rows each
    slabs = max(1, parted.count() // (2 * block))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_links(one, threshold) for _, one in pdf.groupby(["dims", "t", "code", "left", "right"])]
        return pd.concat(found or [pd.DataFrame({"cls": [], "root": [], "n": []})])

    found = saved(
        parted.join(codes.select("cls", "own", "near"), "cls")
        .join(classes.select("cls", "embedding", "copies"), "cls")
        .groupBy(F.expr(f"pmod(xxhash64(dims, t, code, left, right), {slabs})"))
        .applyInPandas(compare, "cls bigint, root bigint, n bigint"),
        "links",
    )
    tied = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    root = (
        classes.join(tied.select(F.col("a").alias("cls"), F.col("b").alias("root")), "cls", "left")
        .join(counts, "cls", "left")
        .select("embedding", "least", F.coalesce("root", "cls").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = root.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = root.join(named, "root").select("embedding", "n_links", "component_id")
    linked = good.join(labels, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable("embedding")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))

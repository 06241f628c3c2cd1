"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, exactly as a uniform permutation of all rows
would give it: a matrix with the partitions' sizes and the shards' sizes as margins, one hypergeometric draw per
cell. Each partition permutes its rows where they are and deals them out in runs of the drawn lengths. After the
exchange, the only one, each shard permutes again, in slices that bound a task's sort, which gives the slots. The
matrix has partitions x shards cells, ``groups`` x shards at most, and is drawn on the driver; rows never leave
DataFrame functions.
"""

from __future__ import annotations

from math import exp, lgamma, log, pi, sqrt
from random import Random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, saved, table

#: Rows that a slice of a shard holds on average, at most.
SLICE_ROWS = 1_000_000


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula; by its series where that is exact to the last digits."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) > 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 0
    while True:
        j += 1
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return more
        total = more


def log_binomial(k: int, n: int, p: float) -> float:
    """log of the binomial probability of k in n, by its saddle point: digits hold at any n."""
    q = 1 - p
    if k == 0:
        return n * log(q) if q > 0.5 or n < 2 else -_deviance(n, n * q) - n * p
    if k == n:
        return n * log(p) if p > 0.5 or n < 2 else -_deviance(n, n * p) - n * q
    spread = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
    return spread + 0.5 * log(n / (2 * pi * k * (n - k)))


def log_hypergeometric(k: int, good: int, bad: int, draws: int) -> float:
    p = draws / (good + bad)
    return log_binomial(k, good, p) + log_binomial(draws - k, bad, p) - log_binomial(draws, good + bad, p)


def hypergeometric(rng: Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, by inversion outwards from the mode; expected time
    grows with the standard deviation."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p_mode = exp(log_hypergeometric(mode, good, bad, draws))
    while True:
        u = rng.random() - p_mode
        if u < 0:
            return mode
        up, down, p_up, p_down = mode, mode, p_mode, p_mode
        while p_up > 0 or p_down > 0:
            if up < high:
                p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
                up += 1
                u -= p_up
                if u < 0:
                    return up
            else:
                p_up = 0.0
            if down > low:
                p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
                down -= 1
                u -= p_down
                if u < 0:
                    return down
            else:
                p_down = 0.0
        # rounding has left a sliver of probability: draw anew


def matrix(sizes: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Counts with row sums ``sizes`` and column sums ``capacities``, as a uniform permutation deals them."""
    rng, left, out = Random(seed), list(capacities), []
    for size in sizes:
        row, rest, pool = [], size, sum(left)
        for k, have in enumerate(left):
            pool -= have
            n = hypergeometric(rng, have, pool, rest)
            row.append(n)
            left[k] -= n
            rest -= n
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 24, groups: int = 16_384, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)`` plus ``size, text_crc32, law, shard, slot,
    grown_shard``; shards differ by one row at most and slots run from 0 without a gap. A column of ``docs``
    with one of these names gives way; all others stay, whatever their names.

    Size is the text's UTF-8 bytes plus 8; a null text has size 8 and the CRC of the empty text, as has an
    empty one. Repeated rows and null ids are rows like any other and are dealt out independently. The same files,
    read in the same partitions, give the same shards. Fewer rows than shards: the last shards are empty. Empty
    table: no rows.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    mixed, place, part, rank, slice_, ends, before = (free_name(base, f"_{n}") for n in ("mixed", "place", "part", "rank", "slice", "ends", "before"))
    bytes_ = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # the local permutation: a row's own position, not its content, decides where it goes
    rows = saved(
        base.coalesce(groups)
        .withColumn(mixed, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
        .sortWithinPartitions(mixed)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn("size", F.octet_length(bytes_).cast("bigint") + 8)
        .withColumn("text_crc32", F.crc32(bytes_))
        .drop(mixed),
        "sharding",
    ).withColumns({part: F.expr(f"int(shiftright({place}, 33))"), rank: F.expr(f"{place} & {(1 << 33) - 1}L")})
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # ``groups`` rows at most
    parts, total = sorted(sizes), sum(sizes.values())
    if not total:
        parts, sizes = [0], {0: 0}
    cells = matrix([sizes[p] for p in parts], [total // shards + (s < total % shards) for s in range(shards)], seed)
    sums = [sum(row[: s + 1]) for row in cells for s in range(shards)]
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    runs = docs.sparkSession.range(len(parts)).select(
        F.element_at(longs(parts), F.col("id").cast("int") + 1).cast("int").alias(part),
        F.slice(longs(sums), F.col("id").cast("int") * shards + 1, F.lit(shards)).alias(ends),
    )
    # one row of ``shards`` numbers per partition
    sent = rows.join(F.broadcast(runs), part).withColumn("shard", F.expr(f"size(filter({ends}, e -> e <= {rank}))")).drop(ends, part, rank)
    # the second permutation, by slices of equal shares of each shard
    slices = max(1, -(-total // (shards * slice_rows)))
    again = F.xxhash64(F.lit(seed + 1), place)
    sent = sent.withColumn(slice_, F.pmod(again, F.lit(slices)).cast("int"))
    counts = sent.groupBy("shard", slice_).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", slice_, (F.sum("n").over(Window.partitionBy("shard").orderBy(slice_)) - F.col("n")).alias(before))
    order = Window.partitionBy("shard", slice_).orderBy(F.xxhash64(F.lit(seed + 2), place), place)
    return (
        sent.join(F.broadcast(offsets), ["shard", slice_])  # shards x slices rows
        .withColumn("law", F.lit("rows"))
        .withColumn("slot", F.col(before) + F.row_number().over(order) - 1)
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*base.columns, *added)
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "lang", "source")

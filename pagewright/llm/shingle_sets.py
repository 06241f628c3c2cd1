"""Pairs of texts by Jaccard similarity of their word shingles: the exact part of the SimHash operator's ``keep_one``.

Fingerprints within 3 bits stand for similarities of about 0.95 and more; pairs down to a threshold of 0.8 differ by
10 bits on average and by 16 at times, where balls hold more points than can be emitted. This join finds those pairs.

Shingles are 64-bit hashes, ordered by value, the commonest last. Two sets within the threshold share one of the
first |s| - ceil(threshold x |s|) + 1 hashes of each (prefix filter), so documents meet in a shuffle on those. A hash
that few documents hold ties all of them pair by pair. One that many hold ties each to one of few hubs, and then those
that all links have left outside the largest component there are compared with all others block by block, so that no pair
is lost and none below the threshold becomes a row. Sizes and places in both orders drop other pairs that cannot reach
the threshold; the rest are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch

WORDS, THRESHOLD = 5, 0.8
#: Documents at a hash up to which every pair is tied, and hubs of hashes that more documents hold.
PAIRWISE, HUBS = 16, 8
#: Sets and hashes in one block of a group compared block by block, and hashes compared at a time there.
BLOCK, BLOCK_HASHES, COLUMNS = 128, 2_000_000, 4_096
#: Hashes of a set up to which 16 bits of each tell sets apart well enough there.
LONG = 4_096
#: Ids, or groups, up to this number are broadcast to the texts, or sets; more meet them by shuffle.
BROADCAST_ROWS = 1_000_000
#: Common hashes: of one set in so many, those met so often, so many at most.
SAMPLE, MET, MOST = 16, 4, 200_000


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Hashes of one text's distinct k-word shingles, ascending; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    n, k = len(words), min(k, len(words))
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def simhash(s: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 15):
        counts += np.unpackbits(s[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s), bitorder="little").view(np.int64)[0])


def bits_of(s: np.ndarray) -> bytes:
    """A bitmap of four bits or more to a hash, a power of two in all; two sets differ in at least as many hashes as their
    bitmaps in bits."""
    width = max(1024, 1 << (4 * len(s) - 1).bit_length())
    on = np.zeros(width, np.uint8)
    on[s & (width - 1)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps; the longer is folded to the length of the shorter first."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signature(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes())).view(np.int64))


def with_shingles(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``(sig, s)`` of every row: one hash of all, and the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = [shingles(t, k) for t in b.column(0).slice(at, 200).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(_signature, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sig", "s"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "sig bigint, s array<bigint>")


def common_shingles(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """The commonest hashes of one text in ``SAMPLE``, ``MOST`` at most, ascending. They only order the others: any choice
    finds the same pairs."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = with_shingles(sample, k).select("sig", F.explode("s").alias("key")).distinct().groupBy("key").count()
    top = counts.where(F.col("count") >= MET).orderBy(F.desc("count"), "key").limit(MOST)
    return np.array(sorted(r["key"] for r in top.collect()), np.int64)


def with_prefixes(docs: DataFrame, common: np.ndarray, k: int, threshold: float) -> DataFrame:
    """``(doc_id, sig, n, fp, bits, own, first)`` of every row: signature, size, SimHash and bitmap of its set, how many of its
    hashes aren't common, and its prefix, common ones last."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sig, n, fp, bits, own, first = [], [], [], [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    v = shingles(t, k)
                    sig.append(_signature(v))
                    n.append(len(v))
                    fp.append(simhash(v))
                    bits.append(bits_of(v))
                    late = last[np.minimum(np.searchsorted(last, v), len(last) - 1)] == v if len(last) else np.zeros(len(v), bool)
                    v = np.concatenate((v[~late], v[late]))
                    own.append(len(v) - int(late.sum()))
                    first.append(v[: len(v) - ceil(threshold * len(v) - 1e-9) + 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(bits, pa.binary()), pa.array(own, pa.int32()), pa.array(first, pa.list_(pa.int64()))],
                    ["doc_id", "sig", "n", "fp", "bits", "own", "first"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, sig bigint, n int, fp bigint, bits binary, own int, first array<bigint>")


def _ends(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(x, y)`` that share a hash at ``x.i`` and ``y.i`` -> distinct ``(a, b)`` that can still overlap enough."""
    most = F.least("x.i", "y.i") + F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = most >= (F.col("x.n") + F.col("y.n")) * F.lit(threshold / (1 + threshold)) - 1e-6
    return pairs.where("x.sig <> y.sig").where(enough).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def meetings(prefixes: DataFrame) -> DataFrame:
    """``prefixes(sig, n, own, first)``, distinct -> ``(key, held, x, hub)`` for every hash that several sets hold.

    Common hashes, those of ``first`` from place ``own`` on, are counted where they lie and their hubs broadcast, ``MOST``
    rows at most. Only the others are dealt out by key: the sample met each of them less often than the common ones."""
    # the order of hubs depends on the document and one of few seeds, so that hashes of one group agree on them
    order = F.xxhash64("sig", F.pmod("key", F.lit(HUBS))).alias("o")
    keyed = prefixes.where("n > 0").select("sig", "n", "own", F.posexplode("first").alias("i", "key"))
    by = "over (partition by key)"
    # dealt out before anything is added, so that rows travel short
    few = keyed.where("i < own").select("sig", "n", "i", "key").repartition("key").select("*", order)
    few = few.select("key", "sig", "n", "i", F.expr(f"count(*) {by}").alias("held"), F.expr(f"min(struct(o, sig, n, i)) {by}").alias("hub")).where("held > 1")
    many = keyed.where("i >= own").select("key", "sig", "n", "i")
    heads = many.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct(order, "sig", "n", "i")).alias("hub")).where("held > 1")
    met = few.union(many.join(F.broadcast(heads), "key"))
    return met.select("key", "held", F.struct("sig", "n", "i").alias("x"), F.struct("hub.sig", "hub.n", "hub.i").alias("hub"))


def candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """Every pair at hashes that few hold, and each with the hub at the others."""
    few = shared.where(F.col("held") <= PAIRWISE).groupBy("key").agg(F.collect_list("x").alias("all"))  # PAIRWISE at most
    pairs = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.sig < y.sig")
    return _ends(pairs.union(shared.where(F.col("held") > PAIRWISE).select("x", F.col("hub").alias("y"))), threshold)


def still_apart(docs: DataFrame, nodes: DataFrame, shared: DataFrame, tied: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` at hashes that many hold and whose ends no link has tied: all but the largest component there,
    against all. Hashes whose hubs are tied count as one group. Groups are compared in blocks of bounded size, and only pairs whose
    shortened hashes overlap enough leave a block; rows grow with a group's size times its number of blocks."""
    many = shared.where(F.col("held") > PAIRWISE).select(F.col("hub.sig").alias("hub"), F.col("x.sig").alias("sig"), F.col("x.n").alias("n")).distinct()
    roots = tied.select(F.col("a").alias("sig"), F.col("b").alias("root"))
    # hubs of one component count as one, so that pairs which share many hashes meet there once
    many = many.join(tied.select(F.col("a").alias("hub"), F.col("b").alias("top")), "hub", "left").select(F.coalesce("top", "hub").alias("hub"), "sig", "n").distinct()
    with scratch(docs.sparkSession) as kept:
        named = kept(many.join(roots, "sig", "left").select("hub", "sig", "n", F.coalesce("root", "sig").alias("root")), "many")
        parts = named.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        groups = parts.groupBy("hub").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "root", "n")).alias("top"), F.count(F.lit(1)).alias("parts"))
        blocks = lambda m, n: F.ceil(F.least(m, F.greatest(m / BLOCK, n / BLOCK_HASHES))).cast("int")
        sizes = kept(groups.where("parts > 1").select("hub", "main", blocks(F.col("m"), F.col("n")).alias("wide"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("high")), "sizes")
        # rows stay where they lie; if there are too many groups for that, the join can split a large one
        there = kept(named.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "hub"), "there")
        own = lambda of: F.pmod(F.xxhash64("sig"), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        all_of = there.select("hub", own("wide").alias("i"), each("high").alias("j"), "sig", "n", "root", F.lit(False).alias("rest"))
        rest = there.where("root <> main").select("hub", each("wide").alias("i"), own("high").alias("j"), "sig", "n", "root", F.lit(True).alias("rest"))
        short = whole_sets(docs, nodes, there.select("sig").distinct(), with_short_shingles, k, kept)

        def near(t: pa.Table) -> pa.Table:
            return _near_in_block(t, threshold)

        met = all_of.union(rest).join(short, "sig").groupBy("hub", "i", "j").applyInArrow(near, "a bigint, b bigint")
        return saved(met.distinct(), "apart")


def _near_in_block(t: pa.Table, threshold: float) -> pa.Table:
    """Rows of ``rest`` against the others of one block, by the overlap of their shortened hashes: at least that of the
    hashes but for those that fall together in a set, which are allowed for."""
    sig, n, root, rest = (t.column(c).to_numpy() for c in ("sig", "n", "root", "rest"))
    sets = [np.frombuffer(s, np.int32 if m > LONG else np.int16) for s, m in zip(t.column("s").to_pylist(), n.tolist(), strict=True)]
    if n.min() <= LONG:
        sets = [s.astype(np.int16) for s in sets]
    at = np.repeat(np.arange(len(sig)), [len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    # once per set, and only what several rows hold
    once = np.unique(at * np.int64(max(len(values), 1)) + code)
    at, code = np.divmod(once, max(len(values), 1))
    joint = n - np.bincount(at, minlength=len(sig))
    several = np.bincount(code, minlength=len(values)) > 1
    at, code = at[several[code]], np.cumsum(several)[code[several[code]]] - 1
    x, y = np.flatnonzero(~rest), np.flatnonzero(rest)
    over = np.zeros((len(y), len(x)), np.float32)
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    for start in range(0, int(several.sum()), COLUMNS):
        i, j = np.searchsorted(code, (start, start + COLUMNS))
        held = np.zeros((len(sig), COLUMNS), np.float32)
        held[at[i:j], code[i:j] - start] = 1
        over += held[y] @ held[x].T
    over += np.minimum(joint[y][:, None], joint[x][None, :])
    fit = over >= (n[y][:, None] + n[x][None, :]) * (threshold / (1 + threshold)) - 1e-3
    i, j = np.nonzero(fit & (root[y][:, None] != root[x][None, :]))
    a, b = sig[y[i]], sig[x[j]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def with_short_shingles(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``(sig, s)`` of every row: one hash of all, and 16 bits of each hash, or 32 in sets of more than ``LONG``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, short = [], []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                v = shingles(t, k)
                sig.append(_signature(v))
                short.append((v >> 32).astype(np.int32 if len(v) > LONG else np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(short, pa.binary())], ["sig", "s"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "sig bigint, s binary")


def whole_sets(docs: DataFrame, nodes: DataFrame, sigs: DataFrame, made: Callable[[DataFrame, int], DataFrame], k: int, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``(sig, s)`` of ``sigs(sig)``, distinct: their sets, ``made`` again from one text each."""
    found = kept(nodes.join(sigs, "sig", "left_semi").select("sig", "least"), "found")
    ids = kept(found.select("least").distinct(), "ids")
    again = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("least")), "left_semi")
    return kept(made(again, k).join(found, "sig", "left_semi").groupBy("sig").agg(F.first("s").alias("s")), "sets")


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``pairs(a, b)`` that meet the threshold: dropped where bitmaps differ in more bits than sets may in hashes, then
    counted on whole sets, which are made again for what is left."""
    most = (1 - threshold) / (1 + threshold)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))
            fit = [bits_apart(*e) <= (i + j) * most + 1e-6 for i, j, *e in zip(na, nb, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    end = lambda e: nodes.select(F.col("sig").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"bits{e}"))
    with scratch(docs.sparkSession) as kept:
        left = kept(pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(may, "a bigint, b bigint"), "left")
        ends = left.select(F.col("a").alias("sig")).union(left.select(F.col("b").alias("sig"))).distinct()
        sets = whole_sets(docs, nodes, ends, with_shingles, k, kept)
        both = left.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
        n = F.size(F.array_intersect("sa", "sb"))
        return saved(both.where(n >= (F.size("sa") + F.size("sb") - n) * F.lit(threshold) - 1e-9).select("a", "b"), "links")

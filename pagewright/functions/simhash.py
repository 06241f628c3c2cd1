"""The 64-bit SimHash of a text as a column expression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(bits: int) -> int:
    """An unsigned 64-bit number as the bigint of the same bits."""
    return bits - (1 << 64) if bits >> 63 else bits


def _majority(hashes: Column, lanes: int) -> Column:
    """The bits set in over half of ``hashes``, counted in one pass: each of 64 / ``lanes`` longs holds ``lanes`` counters,
    so that a word costs so many additions. A counter holds numbers below 2 ** (64 / lanes)."""
    longs = 64 // lanes
    low = sum(1 << (longs * j) for j in range(lanes))  # the lowest bit of every counter
    names = [f"c{i}" for i in range(longs)]
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in names])

    def count(so_far: Column, h: Column) -> Column:
        return F.struct(*[(so_far[c] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(low).cast("bigint"))).alias(c) for i, c in enumerate(names)])

    def bits(total: Column) -> Column:
        half = F.size(hashes)
        value = F.lit(0).cast("bigint")
        for i, c in enumerate(names):
            for j in range(lanes):
                votes = F.shiftrightunsigned(total[c], longs * j).bitwiseAND(F.lit((1 << longs) - 1).cast("bigint"))
                value = value.bitwiseOR(F.when(votes * 2 > half, F.lit(signed(1 << (i + longs * j)))).otherwise(F.lit(0).cast("bigint")))
        return value

    return F.aggregate(hashes, zero, count, bits)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """The low 64 bits of the md5 of each word."""
    return F.transform(words(text), lambda w: F.conv(F.right(F.md5(w.cast("binary")), F.lit(16)), 16, -10).cast("bigint"))


def majority_bits(hashes: Column) -> Column:
    """The bits set in over half of an array of bigints. Texts of 65,536 words and more take wider counters."""
    return F.when(F.size(hashes) < 1 << 16, _majority(hashes, 4)).otherwise(_majority(hashes, 2))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_of_words(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: (..., words) -> (..., simhash), ``majority_bits`` of the ``word_hashes``. Each different word of
    ``rows`` texts is hashed once, and the bits of a text's words are counted as rows of one matrix."""
    for whole in batches:
        for at in range(0, len(whole), rows):
            b = whole.slice(at, rows)
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten().dictionary_encode()
            hashed = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[8:] for w in flat.dictionary.cast(pa.binary()).to_pylist())
            bits, codes = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1), flat.indices.to_numpy()
            sizes = pc.list_value_length(lists).to_numpy()
            ends = np.cumsum(sizes)
            votes = np.array([bits[codes[e - n : e]].sum(axis=0, dtype=np.int64) for n, e in zip(sizes, ends, strict=True)]).reshape(-1, 64)
            out = np.packbits(votes * 2 > sizes[:, None], axis=1).view(">i8").astype(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "simhash"])


def pairs_within(within: int, tests: int = 1 << 17) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``applyInArrow`` on groups of (site, low, high, part, first, simhash): every row of part ``low`` with every row
    of part ``high``, within one part every two rows once, as (site, a, b, distance) where at most ``within`` bits differ.
    About ``tests`` fingerprints are compared at a time and their pairs handed on, so the pairs of a group are never held."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("first").combine_chunks()
        site, low, high = (rows.column(c)[0] for c in ("site", "low", "high"))
        first, part = rows.column("first").combine_chunks(), rows.column("part").to_numpy()
        hashes = rows.column("simhash").to_numpy().view(np.uint64)
        left, right = (np.flatnonzero(part == p.as_py()) for p in (low, high))
        step = max(1, tests // max(1, len(right)))
        for at in range(0, len(left), step):
            l, r = left[at : at + step], right[at + 1 :] if low == high else right  # noqa: E741
            differ = np.bitwise_count(hashes[l][:, None] ^ hashes[r]).ravel()
            found = np.flatnonzero(differ <= within)
            nth = found // max(1, len(r)) * (within + 1) + differ[found]  # by row and distance, as runs take less disk
            found = found[np.argsort(nth.astype(np.min_scalar_type(step * (within + 1))), kind="stable")]
            i, j = np.divmod(found, max(1, len(r)))
            one, two = l[i], r[j]
            if low == high:
                later = one < two
                one, two, found = one[later], two[later], found[later]
            a, b = (first.take(pa.array(f(one, two))) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.repeat(site, len(found)), a, b, pa.array(differ[found].astype(np.int32))], ["site", "a", "b", "distance"])

    return pairs

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits have a point between them within 1 bit of the one and 2 of the other. Both
emit the points of a ball around themselves and meet there, in a shuffle on those points. Parity tells which
ball is due: fingerprints an odd distance apart differ in the parity of their set bits, so those of even
parity emit the ball of radius 1 (65 points), those of odd parity that of radius 2 (2,081), and every pair
within 3 bits still shares a point. All that meet at a point and hold one member within 1 bit of it lie
within 3 bits of that member: links are stars around it, verified, never all pairs, and a point can gather
2,081 fingerprints at most, however many rows are copies.

Before that, the same meeting on the two 32-bit halves (a pair within 3 bits differs by at most 1 in one of
them) finds the fingerprints that can have a neighbour at all; only those emit 64-bit balls.

``keep_one``, the pipeline's stage, asks for a Jaccard similarity of 0.8 over five-word shingles instead of for
bits. Balls name the close copies there, an exact join of shingle sets those that lie beyond 3 bits
(``shingle_sets.py``); every pair is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_sets
from .common import saved, scratch, table
from .components import components

RADIUS = 3
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text's k-word shingles (XXH64), repeats counted; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    k = min(k, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    ends, counts = ends[k - 1 :].tolist(), np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([xxh64_intdigest(line[i:j], seed) for i, j in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    on = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(on.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, fp bigint)`` of every row; one narrow pass, texts go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct -> those that can lie within 3 bits of another: they share a half-word or a
    half-word 1 bit away. A superset; no pair is lost."""
    half = F.col("half")
    ball = F.expr("concat(array(half), transform(sequence(0, 31), i -> half ^ shiftleft(1L, i)))")
    halves = fps.select("fp", F.posexplode(F.array(F.expr("shiftrightunsigned(fp, 32)"), F.expr("fp & 4294967295L"))).alias("side", "half"))
    keyed = halves.select("fp", "side", F.explode(F.when(F.bit_count(half) % 2 == 1, ball).otherwise(F.array(half))).alias("key"))
    met = keyed.groupBy("side", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    return keyed.join(met, ["side", "key"], "left_semi").select("fp").distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct -> verified links ``(a, b)`` whose components are those of "within 3 bits"."""
    odd = F.bit_count("fp") % 2 == 1
    one = "if({0} < 64, shiftleft(1L, {0}), 0L)"
    points = (
        fps.select("fp", odd.alias("odd"), F.explode(F.expr("sequence(0, 64)")).alias("i"))
        .select("fp", "i", F.explode(F.expr("if(odd and i < 64, sequence(i + 1, 64), array(64))")).alias("j"))
        .select("fp", F.expr(f"fp ^ {one.format('i')} ^ {one.format('j')}").alias("point"))
    )
    # a point gathers at most the 2,081 fingerprints of its own ball, so this window is bounded
    hub = F.expr("min(if(bit_count(fp ^ point) <= 1, fp, null)) over (partition by point)")
    return (
        points.select("fp", hub.alias("hub"))
        .where(f"hub <> fp and bit_count(fp ^ hub) <= {RADIUS}")
        .select(F.col("fp").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; k-word shingles. Null, empty and blank texts
    have no words: fingerprint zero, linked with each other and whatever lies within 3 bits. Repeated rows stay and
    share a component. A null doc_id stays, and names a component only if no other id does (then null).
    Empty table: no rows. Extra columns are left out.
    """
    rows = saved(with_fingerprints(docs, k), "fingerprints")
    # copies fold into one row before anything is emitted
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    fps = nodes.select("fp")
    tied = components(ball_links(saved(near_fingerprints(fps), "near")))
    root = nodes.join(tied.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = root.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = root.join(named, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.expr("lpad(lower(hex(fp)), 16, '0')").alias("fingerprint"), "component_id")


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """``nodes(sig, fp)`` -> pairs ``(a, b)`` of sets: those of one fingerprint with its least, and the least ones
    of linked fingerprints. Stars again, never all pairs."""
    first = saved(nodes.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    same = nodes.join(first, "fp").where("sig <> head").select(F.col("sig").alias("x"), F.col("head").alias("y"))
    tied = ball_links(saved(near_fingerprints(first.select("fp")), "near"))
    head = lambda end, name: first.select(F.col("fp").alias(end), F.col("head").alias(name))
    other = tied.join(head("a", "x"), "a").join(head("b", "y"), "b").select("x", "y")
    return same.union(other).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar(docs: DataFrame, k: int = shingle_sets.WORDS, threshold: float = shingle_sets.THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, component_id)``, one row per input row: components of "Jaccard
    similarity of k-word shingle sets at least ``threshold``", named by their least doc_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space. Texts without words are copies of each other. A null
    doc_id names a component only if no other id does (then null). Repeated rows stay. Empty table: no rows. Extra
    columns are left out.
    """
    common = shingle_sets.common_shingles(docs, k)
    rows = saved(shingle_sets.with_prefixes(docs, common, k, threshold).withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    # copies fold into one row before anything is emitted
    one = rows.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"))
    nodes = saved(rows.select("rid", "n", "fp", "bits").join(one, "rid"), "nodes")
    with scratch(docs.sparkSession) as kept:
        one_each = kept(rows.select("rid", "sig", "n", "own", "first").join(nodes.select("rid"), "rid", "left_semi"), "first")
        shared = saved(shingle_sets.meetings(one_each), "shared")
    pairs = saved(_ball_pairs(nodes.where("n > 0")).union(shingle_sets.candidates(shared, threshold)).distinct(), "pairs")
    linked = shingle_sets.links(docs, nodes, pairs, k, threshold)
    tied = components(linked)
    more = saved(shingle_sets.still_apart(docs, nodes, shared, tied, k, threshold).join(pairs, ["a", "b"], "left_anti"), "apart")
    if not more.isEmpty():
        tied = components(linked.union(shingle_sets.links(docs, nodes, more, k, threshold)))
    root = nodes.join(tied.select(F.col("a").alias("sig"), F.col("b").alias("root")), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    labels = root.join(root.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")
    return rows.select("doc_id", "sig").join(labels, "sig").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near-duplicates of a smaller doc_id; all columns and their order stay.
    Null and empty texts are copies of each other. Rows repeating a doc_id stay with it; rows without an id stay.
    Empty table: no rows. Extra columns stay, whatever their names."""
    gone = similar(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

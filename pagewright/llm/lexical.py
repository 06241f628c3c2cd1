"""Ranked lexical search by Block-Max MaxScore.

The index is dealt into shards of bounded size, each an inverted index of its own: a row per term with the list's
highest impact, and blocks of 64 postings with their first and last document, highest impact and packed bytes. Per
query a shard walks its documents in windows. Lists whose bounds together cannot pass the k-th score so far are
non-essential: they bring no candidates, and a candidate of the essential lists meets them from the largest bound
down, first by the maximum of the block it would lie in, and only if that may suffice by the unpacked block.
The shards' heaps are merged at the end, twice cut to k rows a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved, table

#: Terms: runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings to a block, documents to a window.
BLOCK, WINDOW = 64, 512
#: A shard closes at so many postings or documents; documents of a shard are numbered in 16 bits.
POSTINGS, DOCUMENTS = 2_000_000, 65_000
#: Different query terms that are searched for at a time; they travel to every task.
QUERY_TERMS = 200_000
#: The name of the row that holds a shard's documents: no term is empty.
NO_TERM = ""
#: Stands for a null doc_id inside the index.
NULL_ID = np.iinfo(np.int64).max
HEAD = np.dtype([("first", "<u2"), ("last", "<u2"), ("n", "u1"), ("wide", "u1"), ("most", "<i4"), ("size", "<u2")])
INDEX = "shard bigint, term string, df int, most int, heads binary, packed binary"


def term_bytes() -> bytes:
    """The table for bytes.translate that lower-cases A-Z and blanks every byte that no term holds."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts for, without its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def as_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)


class Packed:
    """Postings in order of (term, document) as blocks: ``heads``, ``data``, and where each term's part of them ends."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        at = np.arange(len(term))
        opens = np.r_[True, term[1:] != term[:-1]]
        self.term_starts = np.flatnonzero(opens)
        in_list = at - np.repeat(self.term_starts, np.diff(np.r_[self.term_starts, len(term)]))
        starts = np.flatnonzero(in_list % BLOCK == 0)
        n = np.diff(np.r_[starts, len(term)])
        gap = doc.astype(np.int64)
        gap[1:] -= doc[:-1]
        gap[starts] = 0  # the first document stands in the head
        heads = np.zeros(len(starts), HEAD)
        heads["first"], heads["last"], heads["n"] = doc[starts], doc[starts + n - 1], n
        heads["most"] = np.maximum.reduceat(impact(tf, m[doc]), starts)
        gap_width = np.where(np.maximum.reduceat(gap, starts) < 256, 1, 2)
        most_tf = np.maximum.reduceat(tf, starts)
        tf_width = np.where(most_tf < 256, 1, np.where(most_tf < 65536, 2, 4))
        heads["wide"], heads["size"] = gap_width * 8 + tf_width, n * (gap_width + tf_width)
        ends = np.cumsum(heads["size"].astype(np.int64))
        data, begins = np.zeros(ends[-1], np.uint8), ends - heads["size"]
        for values, widths, skip in ((gap, gap_width, 0 * n), (tf, tf_width, n * gap_width)):
            for w in np.unique(widths):
                mine = np.flatnonzero(widths == w)
                data[ragged((begins + skip)[mine], n[mine] * w)] = as_bytes(values[ragged(starts[mine], n[mine])], int(w)).ravel()
        first_block = np.searchsorted(starts, self.term_starts)
        self.heads, self.data, self.first_block = heads, data, first_block
        self.blocks = np.diff(np.r_[first_block, len(starts)])
        self.head_ends = np.cumsum(self.blocks * HEAD.itemsize)
        self.data_ends = ends[first_block + self.blocks - 1]
        self.df = np.diff(np.r_[self.term_starts, len(term)])
        self.most = np.maximum.reduceat(heads["most"], first_block)


def unpacked(heads: np.ndarray, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of the blocks ``heads`` that begin at ``begins`` in ``data``."""
    n = heads["n"].astype(np.int64)
    ends = np.cumsum(n)
    gap, tf = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int64)
    gap_width, tf_width = (heads["wide"] >> 3).astype(np.int64), (heads["wide"] & 7).astype(np.int64)
    for out, widths, skip in ((gap, gap_width, 0 * n), (tf, tf_width, n * gap_width)):
        for w in np.unique(widths):
            mine = np.flatnonzero(widths == w)
            raw = data[ragged((begins + skip)[mine], n[mine] * w)]
            out[ragged((ends - n)[mine], n[mine])] = raw.view(f"<u{w}")
    total = np.cumsum(gap)
    starts = ends - n
    return total - np.repeat(total[starts] - heads["first"], n), tf


def slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data`` cut at ``ends`` as an Arrow array of binaries."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``docs(doc_id, text)`` -> the index as a table of the shared folder, the number of documents with a term, and
    the number of all their terms. A null text has no terms; repeated rows are documents of their own."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = term_bytes()
        for batch in batches:
            n = [len((text.as_py() or "").encode().translate(clean).split()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], ["some", "total"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(sizes, "some bigint, total bigint")
    some, total = (x or 0 for x in counted.agg(F.sum("some"), F.sum("total")).first())

    def shard_rows(number: int, ids: list, counts: list, lengths: list, vocabulary: dict) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        n = np.array([len(c[0]) for c in counts])
        m = 10 + 90 * np.array(lengths, np.int64)[order] * some // total
        term, tf, doc = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]), np.repeat(place, n)
        by = np.lexsort((doc, term))
        p = Packed(term[by], doc[by], tf[by], m)
        names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())  # numbered as they came, so in order
        cols = [pa.array(np.full(len(names), number)), names, pa.array(p.df.astype(np.int32)), pa.array(p.most.astype(np.int32)), slices(p.heads.view(np.uint8), p.head_ends), slices(p.data, p.data_ends)]
        whole = pa.RecordBatch.from_arrays(cols, ["shard", "term", "df", "most", "heads", "packed"])
        for start in range(0, len(whole), 20_000):
            yield whole.slice(start, 20_000)
        one = [[number], [NO_TERM], [len(ids)], [0], [np.array(ids, "<i8")[order].tobytes()], [m.astype("<i8").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, c.type) for v, c in zip(one, cols, strict=True)], whole.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, number = term_bytes(), TaskContext.get().partitionId() << 24
        ids, counts, lengths, vocabulary, held = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = Counter((text.as_py() or "").encode().translate(clean).split())
                if not words:
                    continue
                known = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                counts.append((np.array(known, np.int32), np.fromiter(words.values(), np.int64, len(words))))
                ids.append(NULL_ID if (i := doc_id.as_py()) is None else i)
                lengths.append(words.total())
                held += len(words)
                if held >= POSTINGS or len(ids) >= DOCUMENTS:
                    yield from shard_rows(number, ids, counts, lengths, vocabulary)
                    number, ids, counts, lengths, vocabulary, held = number + 1, [], [], [], {}, 0
        if ids:
            yield from shard_rows(number, ids, counts, lengths, vocabulary)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, INDEX)
    return saved(rows, "lexical-index"), some, total


class Shard:
    """One shard's lists for the terms of a block of queries; blocks are unpacked when first needed, and kept."""

    def __init__(self, rows: pa.Table) -> None:
        self.lists: dict[str, dict[str, Any]] = {}
        for term, most, heads, packed in zip(*(rows.column(c).to_pylist() for c in ("term", "most", "heads", "packed")), strict=True):
            if term == NO_TERM:
                self.ids, self.m = np.frombuffer(heads, "<i8"), np.frombuffer(packed, "<i8")
                continue
            h = np.frombuffer(heads, HEAD)
            begins = np.cumsum(h["size"].astype(np.int64)) - h["size"]
            self.lists[term] = {"most": most, "heads": h, "first": h["first"].astype(np.int64), "last": h["last"].astype(np.int64), "data": np.frombuffer(packed, np.uint8), "begins": begins, "starts": np.cumsum(h["n"].astype(np.int64)) - h["n"],
                "open": np.zeros(len(h), bool), "docs": np.zeros(int(h["n"].sum()), np.int32), "impact": np.zeros(int(h["n"].sum()), np.int32)}

    def open_blocks(self, x: dict[str, Any], blocks: np.ndarray) -> None:
        new = blocks[~x["open"][blocks]]
        if len(new):
            docs, tf = unpacked(x["heads"][new], x["data"], x["begins"][new])
            at = ragged(x["starts"][new], x["heads"]["n"][new].astype(np.int64))
            x["docs"][at], x["impact"][at] = docs, impact(tf, self.m[docs])
            x["open"][new] = True

    def best(self, terms: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by number) and scores of the ``k`` best, highest first, ties to the smaller number."""
        found = sorted(((w * x["most"], w, x) for t, w in terms if w > 0 and (x := self.lists.get(t))), key=lambda y: y[0])
        bound = np.cumsum([0, *(y[0] for y in found)])  # bound[i]: what the lists before i can give at most
        top_doc, top_score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, len(self.ids) if found else 0, WINDOW):
            essential = int(np.searchsorted(bound, floor, side="right")) - 1
            if essential >= len(found):
                break  # no document can pass any more: an equal score loses to the smaller ids before
            scores = np.zeros(WINDOW, np.int64)
            for _, w, x in found[essential:]:
                a, b = np.searchsorted(x["last"], low), np.searchsorted(x["first"], low + WINDOW)
                if a < b:
                    self.open_blocks(x, np.arange(a, b))
                    s = slice(x["starts"][a], x["starts"][b - 1] + int(x["heads"]["n"][b - 1]))
                    docs, values = x["docs"][s], x["impact"][s]
                    mine = slice(*np.searchsorted(docs, (low, low + WINDOW)))
                    scores[docs[mine] - low] += w * values[mine].astype(np.int64)
            left = np.flatnonzero((scores > 0) & (scores + bound[essential] > floor))
            for i in range(essential - 1, -1, -1):
                if not len(left):
                    break
                _, w, x = found[i]
                block = np.minimum(np.searchsorted(x["last"], left + low), len(x["last"]) - 1)
                inside = (x["first"][block] <= left + low) & (left + low <= x["last"][block])
                may = scores[left] + np.where(inside, w * x["heads"]["most"][block].astype(np.int64), 0) + bound[i] > floor
                left, block, inside = left[may], block[may], inside[may]
                if inside.any():
                    self.open_blocks(x, np.unique(block[inside]))
                    there = left[inside]
                    # unopened blocks hold zeros, so each candidate is looked for inside its own block
                    at = x["starts"][block[inside]] + self._inside(x, block[inside], there + low)
                    hit = x["docs"][at] == there + low
                    scores[there[hit]] += w * x["impact"][at[hit]].astype(np.int64)
                left = left[scores[left] + bound[i] > floor]
            docs, values = np.r_[top_doc, left + low], np.r_[top_score, scores[left]]
            order = np.lexsort((docs, -values))[:k]
            top_doc, top_score = docs[order], values[order]
            floor = int(top_score[-1]) if len(order) == k else 0
        return top_doc, top_score

    @staticmethod
    def _inside(x: dict[str, Any], block: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where in its block each document would stand: a binary search over all blocks at once."""
        low, high = np.zeros(len(block), np.int64), x["heads"]["n"][block].astype(np.int64) - 1
        start = x["starts"][block]
        while (low < high).any():
            mid = (low + high) // 2
            less = x["docs"][start + mid] < doc
            low, high = np.where(less & (low < high), mid + 1, low), np.where(less, high, mid)
        return low


def query_blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[int, Any, list[str]]]]:
    """Queries as (number, item_id, terms), in blocks of at most about ``most`` terms; a query by itself may hold more."""
    clean, out, held = term_bytes(), [], 0
    for number, row in enumerate(queries.select("item_id", F.col("text").cast("string")).toLocalIterator()):
        terms = [w.decode() for w in dict.fromkeys((row[1] or "").encode().translate(clean).split())]
        if out and held + len(terms) > most:
            yield out
            out, held = [], 0
        out.append((number, row[0], terms))
        held += len(terms)
    if out:
        yield out


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``docs(doc_id, text)`` and ``queries(item_id, text)`` -> (item_id, rank, doc_id, score): the ``k`` best
    documents of each query with a score above 0, equal scores by ascending doc_id.

    A null text has no terms; a query without terms has no rows. Each row of queries is a query, also if its id comes
    again or is null; repeated documents are ranked each; a null doc_id comes after all others of its score. Queries
    go to the shards in blocks of ``query_terms`` terms. Empty tables: no rows. Extra columns are left out.
    """
    spark, item = docs.sparkSession, queries.schema["item_id"].dataType
    index, n, _ = build_index(docs)
    schema = StructType([StructField("query", LongType()), StructField("item_id", item), StructField("doc_id", LongType()), StructField("score", LongType()), StructField("lot", LongType())])
    found = spark.createDataFrame([], schema)
    for block in query_blocks(queries, query_terms):
        wanted = sorted({t for _, _, terms in block for t in terms})
        names = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))  # at most query_terms rows, or one query's
        lists = index.join(names, "term", "left_semi")
        df = dict(lists.groupBy("term").agg(F.sum("df")).toLocalIterator())
        ready = spark.sparkContext.broadcast([(q, i, [(t, weight(n, df[t])) for t in terms if t in df]) for q, i, terms in block])
        found = found.unionByName(_search_block(lists.unionByName(index.where(F.col("term") == NO_TERM)), ready, k, schema))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["query", "lot"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(lists: DataFrame, ready: Any, k: int, schema: StructType) -> DataFrame:
    def one_shard(rows: pa.Table) -> pa.Table:
        shard, lot = Shard(rows), rows.column("shard")[0].as_py() % 64
        out: list[list] = [[] for _ in schema]
        for query, item, terms in ready.value:
            docs, scores = shard.best(terms, k)
            ids = [None if i == NULL_ID else i for i in shard.ids[docs].tolist()]
            for c, v in zip(out, ([query] * len(ids), [item] * len(ids), ids, scores.tolist(), [lot] * len(ids)), strict=True):
                c += v
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(out, schema, strict=True)], names=schema.names)

    return lists.groupBy("shard").applyInArrow(one_shard, schema)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS many, sum(n)::BIGINT AS len FROM sized),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, many),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * many) // len))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""

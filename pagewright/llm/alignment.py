"""Cross-tokenizer alignment by inverted pair bitmaps.

Each document is encoded by two tokenizers; the byte offsets where tokens of both end cut it into groups, and the two
tokens that end there are linked. Documents are dealt into chunks of bounded size. Within a chunk each pair of ids has
a posting: a compressed bitmap of its documents (the bytes that aren't zero, and where they stand) and, over the same
bytes, multiplicity planes: plane k holds the documents in which bit k of the pair's number of links is set. Chunks
share no document, so the OR of their bitmaps is disjoint: popcounts add up to document counts, and popcounts of
plane k, times 2**k, to link counts. The counts go back along the postings to the chunks, which hold the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from .common import saved, table

#: A chunk closes at so many documents (bytes of its bitmaps are numbered in 8 bits) or bytes of text.
CHUNK_DOCS, CHUNK_BYTES = 2_048, 6_000_000
#: Text, in characters, that is encoded at a time.
SLICE_CHARS = 500_000
#: Fixed value: the character that stands for a space in pieces.
SPACE_PIECE = "▁"

Encode = Callable[[list[str]], list[np.ndarray]]


def byte_level_encoder(path: str) -> tuple[Encode, list[bytes]]:
    """Texts -> ids by the byte-level BPE file at ``path``, without special tokens, whose strings are plain text; and
    the bytes of each id."""
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    general, by_rank, byte_of = Tokenizer.from_file(path), packing.ranks(spec), packing.byte_characters()
    general.encode_special_tokens = True
    names = {i: t for t, i in general.get_vocab(with_added_tokens=True).items()}
    tokens = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
    fast = tiktoken.Encoding("ranks", pat_str=packing.PIECES, mergeable_ranks=by_rank, special_tokens={}).encode_ordinary if by_rank else None
    blank = re.compile(rf"\s{{{packing.LONG_BLANK}}}")

    def encode(texts: list[str]) -> list[np.ndarray]:
        slow = lambda t: general.encode_batch_fast([t], add_special_tokens=False)[0].ids
        return [np.array(slow(t) if not fast or (len(t) > packing.LONG_BLANK and blank.search(t)) else fast(t), np.int64) for t in texts]

    return encode, tokens


def piece_encoder(path: str) -> tuple[Encode, list[bytes]]:
    """The same for the sentence-piece file at ``path``."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    encode = lambda texts: [np.array(i, np.int64) for i in p.encode(texts, num_threads=1)]
    name = lambda i: p.id_to_piece(i)
    return encode, [bytes([int(name(i)[3:5], 16)]) if p.is_byte(i) else name(i).replace(SPACE_PIECE, " ").encode() for i in range(p.get_piece_size())]


@dataclass
class Side:
    """One tokenizer: its encoder, the bytes and lengths of its ids, and each id's decimal digits with either mark that
    can follow them."""

    encode: Encode
    tokens: list[bytes]
    marks: tuple[bytes, bytes]
    lengths: np.ndarray = field(init=False)
    written: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.written = [str(i).encode() + m for m in self.marks for i in range(len(self.tokens))]

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())) == text


def aligned(a: np.ndarray, b: np.ndarray, sides: tuple[Side, Side], written: np.ndarray) -> tuple[int, np.ndarray, str]:
    """Number of groups, the linked pairs (A id times 2**32 plus B id, in order), and the digest of the groups."""
    ends_a, ends_b = np.cumsum(sides[0].lengths[a]), np.cumsum(sides[1].lengths[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    # in the digest a group's A tokens come before its B tokens: each goes behind what the groups before hold
    code = np.empty(len(a) + len(b), np.int64)
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[last_a], closes_b[last_b] = 1, 1
    code[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = a + closes_a * len(sides[0].tokens)
    code[np.arange(len(b)) + (last_a + 1)[group_b]] = len(sides[0].written) + b + closes_b * len(sides[1].tokens)
    line = b"".join(written[code].tolist())[:-1]
    return len(cuts), (a[last_a] << 32) | b[last_b], hashlib.sha256(line).hexdigest()


def bitmaps(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Postings of a chunk: (pair, places of bytes, bitmap bytes, planes of the same bytes, the lowest plane first)."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    byte = pair * 256 + (doc >> 3)  # A ids stay under 2**23
    starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    bit = (1 << (doc & 7)).astype(np.uint8)
    at, bits = (doc[starts] >> 3).astype(np.uint8), np.bitwise_or.reduceat(bit, starts)
    planes = np.stack([np.bitwise_or.reduceat(np.where((times >> k) & 1, bit, 0).astype(np.uint8), starts) for k in range(int(times.max()).bit_length())])
    opens = np.flatnonzero(np.r_[True, pair[starts][1:] != pair[starts][:-1]])
    ends = np.r_[opens[1:], len(starts)]
    used = np.maximum.reduceat((planes != 0) * np.arange(1, len(planes) + 1)[:, None], opens, axis=1).max(axis=0)
    at_bytes, bit_bytes, low = at.tobytes(), bits.tobytes(), planes[0].tobytes()
    for p, s, e, n in zip(pair[starts][opens].tolist(), opens.tolist(), ends.tolist(), used.tolist(), strict=True):
        yield p, at_bytes[s:e], bit_bytes[s:e], low[s:e] if n == 1 else planes[:n, s:e].tobytes()


DOC_COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RAW = f"kind string, chunk bigint, slot int, {DOC_COLUMNS}, a int, b int, at binary, bits binary, planes binary"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A table with two kinds of rows: ``doc``, one per document with its place in its chunk, and ``pair``, postings."""

    def rows(kind: str, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array([kind] * n) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RAW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Side(*byte_level_encoder(path_a), (b",", b"|")), Side(*piece_encoder(path_b), (b",", b";"))
        written = np.array(sides[0].written + sides[1].written, object)
        chunk, slot, held, found = TaskContext.get().partitionId() << 24, 0, 0, []

        def postings() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)]
            out: list[list] = [[] for _ in range(5)]
            for p, at, bits, planes in bitmaps(*parts) if len(parts[0]) else ():
                for c, v in zip(out, (p >> 32, p & 0xFFFFFFFF, at, bits, planes), strict=True):
                    c.append(v)
                if len(out[0]) == 20_000:
                    yield rows("pair", {"chunk": [chunk] * len(out[0])} | dict(zip(("a", "b", "at", "bits", "planes"), out, strict=True)))
                    out = [[] for _ in range(5)]
            if out[0]:
                yield rows("pair", {"chunk": [chunk] * len(out[0])} | dict(zip(("a", "b", "at", "bits", "planes"), out, strict=True)))

        def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > SLICE_CHARS or len(ids) == 400:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for batch in batches:
            for ids, texts in slices(batch):
                full = [i for i, t in enumerate(texts) if t]
                codes = dict(zip(full, zip(sides[0].encode([" " + texts[i] for i in full]), sides[1].encode([texts[i] for i in full]), strict=True), strict=True))
                out: list[list] = [[] for _ in range(8)]
                for i, doc_id in enumerate(ids):
                    row = (0, 0, 0, 0, "")
                    if i in codes:
                        (a, b), text = codes[i], b" " + texts[i].encode()
                        if sides[0].spells(a, text) and sides[1].spells(b, text):
                            n, pairs, digest = aligned(a, b, sides, written)
                            row = (len(a), len(b), n, n, digest)
                            keys, times = np.unique(pairs, return_counts=True)
                            found.append((keys, np.full(len(keys), slot), times))
                        held += len(text)
                    for c, v in zip(out, (chunk, slot, doc_id, *row), strict=True):
                        c.append(v)
                    slot += 1
                    if slot == CHUNK_DOCS or held >= CHUNK_BYTES:
                        yield from postings()
                        chunk, slot, held, found = chunk + 1, 0, 0, []
                yield rows("doc", dict(zip(("chunk", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), out, strict=True)))
        yield from postings()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, RAW)


def plane_links() -> Column:
    """Links of a posting: the popcount of plane k counts 2**k times."""
    width = F.length("bits")
    each = F.transform(
        F.sequence(F.lit(0), (F.length("planes") / width).cast("int") - 1),
        lambda k: F.bitmap_count(F.substring(F.col("planes"), k * width + 1, width)) * F.pow(F.lit(2), k).cast("bigint"),
    )
    return F.when(F.length("planes") == width, F.bitmap_count("planes")).otherwise(F.aggregate(each, F.lit(0).cast("bigint"), lambda x, y: x + y))


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(a, b, docs, links, best)``: documents and links of each pair, and whether no pair of its B id has more links."""
    pairs = saved(postings.groupBy("a", "b").agg(F.sum(F.bitmap_count("bits")).alias("docs"), F.sum(plane_links()).alias("links")), "pairs")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def back_to_documents(rows: pa.Table) -> pa.Table:
    """Of one chunk's postings with their pairs' counts: the sums of each document."""
    col = lambda c: rows.column(c).to_numpy().astype(np.int64)
    at, planes = rows.column("at").combine_chunks(), rows.column("planes").combine_chunks()
    flat = lambda x: (np.frombuffer(x.buffers()[2] or b"", np.uint8), np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64))
    (at_bytes, at_ends), (plane_bytes, plane_ends) = flat(at), flat(planes)
    width = np.diff(at_ends)
    depth = np.diff(plane_ends) // width
    values = np.stack([col("links"), col("docs"), col("best")])
    sums = np.zeros((3, CHUNK_DOCS), np.int64)
    for k in range(int(depth.max())):
        mine = np.flatnonzero(depth > k)
        n = width[mine]
        index = lambda starts: np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())  # noqa: B023, E731
        place = at_bytes[index(at_ends[:-1][mine])].astype(np.int64)
        set_bits = np.unpackbits(plane_bytes[index(plane_ends[:-1][mine] + k * n)][:, None], axis=1, bitorder="little")
        which, bit = np.nonzero(set_bits)
        of = np.repeat(mine, n)[which]
        for s, v in zip(sums, values, strict=True):
            np.add.at(s, place[which] * 8 + bit, v[of] << k)
    slots = np.flatnonzero(sums[0])
    names = ["chunk", "slot", "count_sum", "docs_sum", "n_best"]
    return pa.table([pa.array(np.full(len(slots), rows.column("chunk")[0].as_py())), pa.array(slots.astype(np.int32)), *(pa.array(s[slots]) for s in sums)], names=names)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, and docs_sum, the sum over links of their pair's number of documents.

    ``path_a`` names a byte-level BPE file, ``path_b`` a sentence-piece model. A null or empty text, and one that either
    tokenizer doesn't spell as it is with a space before it, has zeros and an empty digest. Repeated rows are documents
    of their own and count each; a null doc_id stays null. Empty table: no rows. Extra columns are left out.
    """
    a, b = default_paths()
    rows = saved(encoded(docs, path_a or a, path_b or b), "aligned", "kind")
    postings = rows.where("kind = 'pair'").select("chunk", "a", "b", "at", "bits", "planes")
    counted = postings.select("chunk", "a", "b", "at", "planes").join(pair_counts(postings), ["a", "b"]).select("chunk", "at", "planes", "docs", "links", "best")
    sums = counted.groupBy("chunk").applyInArrow(back_to_documents, "chunk bigint, slot int, count_sum bigint, docs_sum bigint, n_best bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    per_doc = rows.where("kind = 'doc'").join(sums, ["chunk", "slot"], "left")
    return per_doc.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("docs_sum"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))

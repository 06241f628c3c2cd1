"""Packing token streams by concatenate and cut.

Pass 1 tokenizes each document once and writes its ids with the running token count inside its partition.
The partition totals, one number per task, are prefix-summed into global offsets. Pass 2 cuts every document
at the multiples of the sequence length that its global range crosses; a document that crosses one gives a
boundary record on each side. Only the last sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows in an Arrow batch that pass 1 yields.
YIELD = 400
#: Fixed value: how byte-level BPE cuts a text into pieces before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a row from which on a text goes to the general encoder; the fast one recurses there.
LONG_BLANK = 5_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones stand for
    themselves, the others, in turn, are those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [i for i in range(256) if i not in visible]
    return {chr(i): i for i in visible} | {chr(0x100 + n): i for n, i in enumerate(hidden)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id, if ``spec`` is a plain byte-level BPE whose merges come in the order of their ids,
    so that ids alone say what merges first; None for any other tokenizer."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space", True):
        return None
    if spec.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    byte_of, ids = byte_characters(), model["vocab"]
    single = [ids.get(c, -1) for c in byte_of]
    merged = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if min(single) < 0 or any(a >= b for a, b in zip([max(single), *merged], merged, strict=False)):
        return None
    known = {*single, *merged}
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in ids.items() if i in known}


def encoder(path: str) -> tuple[str, Callable[[list[str]], list[bytes]]]:
    """The width of an id ("u2", or "u4" for vocabularies beyond 65,536), and texts -> their ids as bytes of that
    width, little-endian, as the tokenizer's file at ``path`` gives them.

    A plain byte-level BPE is encoded through its ranks, which gives the same ids in half the time. Texts with an
    added token in them or with very long white space, and all other tokenizers, go through the file's own encoder.
    """
    import json
    import os
    import re
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    general, by_rank = Tokenizer.from_file(path), ranks(spec)
    width = "u2" if general.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "u4"
    code = "H" if width == "u2" else "I"
    slow = lambda texts: [array(code, e.ids).tobytes() for e in general.encode_batch_fast(texts, add_special_tokens=False)]
    if by_rank is None:
        return width, slow
    fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=by_rank, special_tokens={}).encode_ordinary
    added, blank = [t["content"] for t in spec.get("added_tokens") or []], re.compile(rf"\s{{{LONG_BLANK}}}")

    def encode(texts: list[str]) -> list[bytes]:
        return [
            slow([t])[0] if any(a in t for a in added) or (len(t) > LONG_BLANK and blank.search(t)) else array(code, fast(t)).tobytes()
            for t in texts
        ]

    return width, encode


def token_rows(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``(part, before, doc_id, n, ids binary)``: ids with the end id, and the tokens before in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (width, encode), part, before = encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end], f"<{width}").tobytes()
        for batch in batches:
            for at in range(0, len(batch), YIELD):
                b = batch.slice(at, YIELD)
                ids = [i + last for i in encode([t or "" for t in b.column(1).to_pylist()])]
                n = np.fromiter((len(i) // len(last) for i in ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(starts), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "part bigint, before bigint, doc_id bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = 1024, end: int = 0, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (and ``ids array<int>`` on request). Sequences hold ``length`` ids, the last one what is left.

    A null or empty text is its end id alone. Long texts run over as many sequences as they fill. Repeated
    rows are packed as often as they occur; a null doc_id stays null. Empty table: no rows. Extra columns are
    left out.
    """
    rows = saved(token_rows(docs, path or default_tokenizer(), end), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task of pass 1, so this window and the broadcast hold as many rows as there were tasks
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, at, n, ids in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                whole, first = np.frombuffer(ids, f"<u{len(ids) // n}"), 0  # the end id makes n at least 1
                while first < n:
                    seq, off = divmod(at + first, length)
                    take = min(length - off, n - first)
                    piece = whole[first : first + take].astype("<u4")
                    for c, v in enumerate((doc, first, take, zlib.crc32(piece.tobytes()), n, seq, off)):
                        out[c].append(v)
                    if with_ids:
                        out[7].append(piece.astype(np.int32))
                    first += take
            cols = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} bigint" for c in names[:7]) + ", ids array<int>" * with_ids
    placed = rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

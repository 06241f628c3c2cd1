import zlib

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import packing  # noqa: E402

TEXTS = ["a  b\n \n c", "x <|endoftext|> y", "", None, "trailing  ", "é" * 3000, "tab\tand nbsp  two", " " * 30_000, "word " * 200_000, "z" * 50_000, "中文 \U0001f600 it's", "same", "same"]


def unpacked(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got[r["doc_id"]] += r["ids"]
    return got


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, with_ids=True).collect()
    assert unpacked(rows) == {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(TEXTS)}
    ends = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in rows)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_a_wide_vocabulary_takes_four_bytes(tmp_path):
    import json

    words = {f"w{i}": i for i in range(70_000)}
    (tmp_path / "t.json").write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": words, "unk_token": "w0"}}))
    width, encode = packing.encoder(str(tmp_path / "t.json"))
    assert width == "u4" and np.frombuffer(encode(["w69999 w1"])[0], "<u4").tolist() == [69_999, 1]


def test_merges_out_of_order_are_left_to_the_general_encoder():
    chars = packing.byte_characters()
    spec = {"model": {"type": "BPE", "vocab": {**{c: i for i, c in enumerate(chars)}, "ab": 257, "cd": 256}, "merges": ["a b", "c d"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    assert packing.ranks(spec) is None
    spec["model"]["vocab"] |= {"ab": 256, "cd": 257}
    assert packing.ranks(spec)[b"ab"] == 256


def test_odd_tables(spark):
    kind = "doc_id long, text string, n long, ids string, part string, before long"
    docs = spark.createDataFrame([(None, "a b", 1, "x", "y", 2), (1, None, None, None, None, None), (1, None, None, None, None, None)], kind)
    got = [tuple(r) for r in packing.pack(docs).select("doc_id", "start", "length", "doc_tokens", "sequence_id").collect()]
    assert sorted(got, key=str) == [(1, 0, 1, 1, 0), (1, 0, 1, 1, 0), (None, 0, 3, 3, 0)]
    assert packing.pack(docs.where("false")).count() == 0

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import alignment, packing  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = ["a  b\n \n c", "x <|endoftext|> y <s></s><unk>", "", None, "trailing  ", "é" * 300, "tab\tand nbsp two", " " * 6_000, "word " * 3_000, "▁ under", "中文 \U0001f600 it's \u0000 nul", "same", "same", "same words", " lead", "ﬁ ligature"]


def plain(docs):
    """Token by token: {row number: the digest columns}."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    t, p, byte_of = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), packing.byte_characters()
    t.encode_special_tokens = True
    links, rows = [], []
    for doc_id, text in docs:
        e = t.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in s)) for i, s in zip(e.ids, e.tokens, strict=True)] if text else []
        b = [(i, bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()) for i in p.encode(text or "") for s in [p.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        at, ends = 0, {}
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, s in tokens:
                at += len(s)
                ends.setdefault(at, [None, None])[side] = i
        cuts, groups, start = [x for x, (i, j) in sorted(ends.items()) if i is not None and j is not None], [], 0
        for cut in cuts:
            inside = [x for x in sorted(ends) if start < x <= cut]
            groups.append("|".join(",".join(str(ends[x][side]) for x in inside if ends[x][side] is not None) for side in (0, 1)))
            start = cut
        links.append([tuple(ends[x]) for x in cuts])
        rows.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for pairs in links for x in pairs)
    docs_of = Counter(x for pairs in links for x in set(pairs))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, na, nb, g, len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), h, sum(docs_of[y] for y in x)) for (d, na, nb, g, h), x in zip(rows, links, strict=True)), key=str)


@pytest.mark.parametrize("chunk", [2_048, 3])
def test_equals_token_by_token(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", chunk)
    docs = [*enumerate(TEXTS), (None, "same"), (11, "same")]
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = plain(docs)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[2] > 0 for r in want) > 10 and any(r[2] == 0 and r[0] is not None and TEXTS[r[0]] for r in want)


def test_query_equals_token_by_token(spark):
    got = alignment.op13_tokenizer_alignment(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got), key=str) == plain(docs)


def test_planes_hold_large_multiplicities():
    rng = np.random.default_rng(4)
    rows = {(int(p) << 32 | 7, int(d)): int(t) for p, d, t in zip(rng.integers(0, 5, 400), rng.integers(0, 2048, 400), rng.choice([1, 2, 1_000, 70_001], 400), strict=True)}
    keys = np.array([[*k, v] for k, v in rows.items()])
    back = {}
    for pair, at, bits, planes in alignment.bitmaps(keys[:, 0], keys[:, 1], keys[:, 2]):
        for k in range(len(planes) // len(at)):
            for j, byte in enumerate(planes[k * len(at) : (k + 1) * len(at)]):
                for bit in range(8):
                    if byte >> bit & 1:
                        assert bits[j] >> bit & 1
                        back[pair, at[j] * 8 + bit] = back.get((pair, at[j] * 8 + bit), 0) + (1 << k)
    assert back == rows


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, "y")], "doc_id long, text string, a string, chunk long, kind string")
    assert [tuple(r)[:2] for r in alignment.align(docs).collect()] == [(1, 2)]
    assert alignment.align(docs.where("false")).count() == 0

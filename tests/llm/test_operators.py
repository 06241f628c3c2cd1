import zlib

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import embedding_dedup, gru, language_id, licenses, lm_scoring, mixing, packing, sharding, simhash_dedup, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _group string, size string"
EDGE = [
    (1, "All rights reserved.\none two three four five", "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, None, None), (None, "word", "en", "a", 4, None, None),
    (5, "one two", "fr", "b", 7, None, None), (5, "one two", "fr", "b", 7, None, None), (6, " \t\n ", "fr", None, 4, None, None), (7, "long text here " * 20000, "de", "c", 300000, None, None),
]
VECTORS = "vec_id long, embedding array<float>, label int"
OPERATORS = {
    "op1": lambda d, s: simhash_dedup.near_duplicates(d), "op2": lambda d, s: lm_scoring.score_documents(d), "op3": lambda d, s: toxicity.classify(d, s.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int")),
    "op4": lambda d, s: language_id.identify(d), "op5": lambda d, s: sharding.shuffle_into_shards(d), "op7": lambda d, s: licenses.scan(d), "op9": lambda d, s: mixing.mix(d), "op10": lambda d, s: packing.pack(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_and_odd_rows(spark, name):
    docs = spark.createDataFrame(EDGE, DOCS)
    assert OPERATORS[name](docs.where("false"), spark).count() == 0
    got = OPERATORS[name](docs, spark).toPandas()
    assert len(got) >= len(EDGE) if name == "op10" else len(got) == len(EDGE)


def test_simhash_components_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 40)
    fps = np.concatenate([base, [b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base[:20] for i, j, k in rng.integers(0, 62, (3, 3))]])
    fps = sorted({int(f) for f in fps})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = {r["fp"] for r in simhash_dedup.near_fingerprints(table).collect()}
    got = {r["a"]: r["b"] for r in simhash_dedup.components(simhash_dedup.ball_links(table)).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                assert {a, b} <= near
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert all(got.get(f, f) == find(f) for f in fps)


def test_fingerprint_of_short_and_empty_texts():
    from xxhash import xxh64_intdigest

    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(b" \n") == 0
    assert simhash_dedup.fingerprint(b"One  TWO") % (1 << 64) == xxh64_intdigest(b"one two", 42)


def test_gru_gradient_and_probabilities():
    rng = np.random.default_rng(0)
    m = {k: v.astype(float) for k, v in gru.fresh(rng.integers(1, 9, gru.VOCABULARY).astype(float)).items()}
    h = np.tanh(rng.normal(size=(1, gru.STATE)))
    every = np.arange(gru.VOCABULARY)
    assert abs((10 ** gru.log10_probabilities(m, np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-9
    texts = [np.append(rng.integers(1, 99, n), gru.END).astype(np.int32) for n in (3, 150, 1)]
    one = [gru.score(m, [t])[0] for t in texts]
    assert np.allclose(gru.score(m, texts), one, rtol=1e-4)


def test_base_score_equals_brute_force(spark):
    from collections import Counter
    from math import log10

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.score_documents(docs, carried=3000).collect():
        ws = words[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(ws) and r["n_known"] == sum(w in c for w in ws)
        assert abs(r["base_score"] - sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred)) a").first()["a"]
    assert got > 0.95


def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:40] + 0.02 * rng.normal(size=(40, 16)), x[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1101, [None] * 16, 0)]
    return spark.createDataFrame(rows + odd, VECTORS), x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)


def test_vector_links_equal_brute_force(spark):
    table, x = vectors(spark)
    got = embedding_dedup.near_duplicate_vectors(table).toPandas().set_index("vec_id")
    assert len(got) == len(x) + 4 and (got.loc[[1000, 1050, 1100, 1101]].n_links == 0).all()
    assert (got.loc[range(len(x))].n_links.to_numpy() == (x @ x.T >= 0.95).sum(1) - 1).all()
    assert embedding_dedup.near_duplicate_vectors(table.where("false")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["a  b\n \n c", "x <|endoftext|> y", "", None, "trailing  ", "é" * 3000, "tab\tand nbsp  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: [*(t.encode(x or "", add_special_tokens=False).ids), 0] for i, x in enumerate(texts)}
    rows = packing.pack(docs, with_ids=True).orderBy("doc_id", "start").collect()
    got = {i: [] for i in want}
    for r in rows:
        assert r["start"] == len(got[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got[r["doc_id"]] += r["ids"]
    assert got == want
    ends = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))

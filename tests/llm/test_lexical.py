import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import lexical  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(docs, queries, k):
    """Brute force over whole texts: {query number: [(doc_id, score)]}."""
    words = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for q, (_, text) in enumerate(queries):
        scores = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // total
            s = sum(lexical.weight(n, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[q] = [(None if none else i, -s) for s, none, i in sorted(scores)[:k]]
    return out


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = lexical.op12_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score")
    want = c.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert want


@pytest.mark.parametrize("window", [8, 512])
def test_equals_brute_force_over_several_shards_and_blocks(spark, monkeypatch, window):
    monkeypatch.setattr(lexical, "POSTINGS", 4_000)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "WINDOW", window)
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(60_000)]
    docs = [(i * 7 % 1201, " ".join(words[rnd.randrange(50_000) :][: rnd.choice([3, 40, 90])])) for i in range(1201)]
    docs += [(2000 + i, docs[5][1]) for i in range(60)] + [(None, docs[6][1]), (9, None), (10, ""), (9, docs[6][1]), (3000, "w1 " * 70_000)]
    queries = [(i, " ".join(rnd.sample(words, 12))) for i in range(20)] + [(20, docs[5][1]), (20, docs[6][1]), (None, "w1 W1 w2"), (21, ""), (22, None), (23, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    qs = spark.createDataFrame(queries, "item_id long, text string").coalesce(1)
    want = sorted((str(queries[q][0]), r + 1, str(d), s) for q, rows in plain(docs, queries, 10).items() for r, (d, s) in enumerate(rows))
    for terms in (lexical.QUERY_TERMS, 30):
        got = sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in lexical.search(df, qs, query_terms=terms).collect())
        assert got == want


def test_blocks_come_back_as_they_were():
    rnd = np.random.default_rng(1)
    pairs = np.unique(rnd.integers(0, 60_000, (5_000, 2)) * [0, 1] + rnd.integers(0, 9, (5_000, 1)) * [1, 0], axis=0)
    tf = rnd.choice([1, 3, 300, 70_000], len(pairs))
    p = lexical.Packed(pairs[:, 0], pairs[:, 1], tf, np.full(60_000, 100))
    docs, back = lexical.unpacked(p.heads, p.data, np.cumsum(p.heads["size"].astype(np.int64)) - p.heads["size"])
    assert docs.tolist() == pairs[:, 1].tolist() and back.tolist() == tf.tolist()


def test_most_blocks_stay_packed():
    """With one rare and one frequent term only blocks of the frequent one near a candidate are unpacked."""
    rows = [(0, d, 1) for d in range(20_000)] + [(1, d, 5) for d in range(0, 20_000, 1_000)]
    a = np.array(rows)
    p = lexical.Packed(a[:, 0], a[:, 1], a[:, 2], np.full(20_000, 100))
    cut = lambda data, ends: [data[s:e].tobytes() for s, e in zip([0, *ends], ends)]  # noqa: E731, B905
    import pyarrow as pa

    ids = np.arange(20_000).astype("<i8").tobytes()
    table = pa.table({"term": ["a", "b", ""], "most": [*p.most.tolist(), 0], "heads": [*cut(p.heads.view(np.uint8), p.head_ends), ids], "packed": [*cut(p.data, p.data_ends), np.full(20_000, 100).astype("<i8").tobytes()]})
    shard = lexical.Shard(table)
    docs, _ = shard.best([("a", 10), ("b", 3_000)], 2)
    assert docs.tolist() == [0, 1_000] and shard.lists["a"]["open"].mean() < 0.2


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, text string, term string, score long, shard long")
    qs = spark.createDataFrame([("i", "A", 5)], "item_id string, text string, rank int")
    assert [tuple(r) for r in lexical.search(docs, qs).collect()] == [("i", 1, 1, 287 * (1_000_000_000 // (1000 + 800)))]
    assert lexical.search(docs.where("false"), qs).count() == 0 and lexical.search(docs, qs.where("false")).count() == 0

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; whoever passes the cap is held there and the rest shared again, until none passes."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, free, out, left = {s: weights[i % 3] for i, s in enumerate(order)}, set(order), {}, sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def brute_mix(rows, spark):
    """``(doc_id, text, source)`` -> multiset of (doc_id, taken), by walking each source's documents in key order."""
    texts = sorted({t or "" for _, t, _ in rows})
    marks = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    none = spark.sql("select xxhash64(cast(null as string)) h").first()["h"]
    by, size, key = {}, [], []
    for i, (d, t, s) in enumerate(rows):
        words = len((t or "").encode().split())
        mean = len(t or "") / max(words, 1) - 1
        kinds = len(set(__import__("re").split(r"[ \t-\r]+", t or "")))
        q = max(0.05, min(1.0, 5.0 * kinds / max(words, 1)) / (1 + max(3 - mean, mean - 9, 0)))
        h = hashlib.md5(f"mix|{'' if d is None else d}|{none if t is None else marks[t]}".encode()).hexdigest()[:13]
        size.append(words)
        key.append(-math.log((int(h, 16) + 0.5) / (1 << 52)) / q)
        by.setdefault(s, []).append(i)
    goals = brute_targets({s: sum(size[i] for i in at) for s, at in by.items()})
    out = []
    for s, at in by.items():
        whole = sum(size[i] for i in at)
        epochs = int(goals[s] // whole) if whole else 0
        budget, sum_ = goals[s] - epochs * whole, 0
        for i in sorted(at, key=lambda i: (key[i], size[i])):
            sum_ += size[i]
            out.append((rows[i][0], size[i] * epochs + max(0, min(size[i], math.floor(budget + 0.5) - (sum_ - size[i])))))
    return out, goals


def rows_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    copies = [(50_000 + i // 40, f"some copied words number {i // 40} here", "src1") for i in range(400)]
    return rows + copies + [(None, "a b c d e f", "src1")] * 30 + [(7, None, None), (8, "", None), (9, "x y z", None), (10, "long " * 50_000, "huge")]


def test_mix_equals_brute_force(spark):
    rows = rows_of(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).toPandas()
    want, goals = brute_mix(rows, spark)
    show = lambda pairs: sorted((-1 if d is None or d != d else int(d), int(t)) for d, t in pairs)
    assert show(zip(got.doc_id, got.taken, strict=True)) == show(want)
    for s, t in goals.items():
        one = got[got.source.isna() if s is None else got.source == s]
        assert np.allclose(one.target, t) and (one["size"].sum() == one.source_size).all()
        assert abs(one.taken.sum() - t) <= 0.5 + 1e-9 and (one.taken <= 3 * one["size"]).all()


def test_mixed_takes_each_row_as_often_as_planned(spark):
    rows = rows_of(spark)
    names = ["_words", "_id", "_size", "_source", "_times", "_copy", "_key", "_src", "size", "target"]
    docs = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(7)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    plan = mixing.mix(docs.select("doc_id", "text", "source")).groupBy().sum("times").first()[0]
    taken = got.collect()
    assert len(taken) == plan and {r[n] for r in taken for n in names} == {"mine"}
    assert mixing.mixed(docs.where("false")).count() == 0 == mixing.mix(docs.where("false")).count()


def test_low_quality_fills_no_part(spark):
    """Whatever the qualities, documents spread over many sub-parts of the key."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 400) as text", "'s' as source")
    got = mixing.mix(docs).toPandas()
    assert got.taken.sum() == got.target.iloc[0] == 20_000


def test_a_corpus_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert list(got.taken) == [0, 0] and list(got.target) == [0, 0]

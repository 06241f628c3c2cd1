import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import nearest  # noqa: E402

KIND = "vec_id long, embedding array<double>, rank string, rid string"


def brute(rows, k=5):
    """Per query row: (id, score) of the k nearest other rows of its length."""
    ok = [(i, v, np.array(e, float)) for i, (v, e) in enumerate(rows) if e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    out = {}
    for i, v, e in ok:
        if v is not None and v % 50 == 0:
            others = [(-(e @ f) / np.sqrt((e @ e) * (f @ f)), float("inf") if u is None else u) for j, u, f in ok if j != i and len(f) == len(e)]
            out.setdefault(v, []).append(sorted(others)[:k])
    return out


def recall(got, want):
    hits = total = 0
    for q, answers in want.items():
        for best in answers:
            total += len(best)
            hits += sum(any(abs(-s - r.score) < 1e-9 for r in got.get(q, [])) for s, _ in best)
    return hits / max(total, 1)


def run(spark, rows, **options):
    table = spark.createDataFrame([(v, e, "x", "y") for v, e in rows], KIND)
    got = {}
    for r in nearest.nearest(table, "vec_id % 50 = 0", **options).toPandas().itertuples():
        got.setdefault(r.query_id, []).append(r)
    return got


def test_recall_and_completeness_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows, sample=2000, block=256), brute(rows)
    assert got.keys() == want.keys() and all(sorted(r.rank for r in g) == [1, 2, 3, 4, 5] for g in got.values())
    assert recall(got, want) >= 0.9


def test_queries_whose_lists_hold_too_few_scan_all(spark):
    """Many tiny far-apart clusters: a list holds fewer than six rows."""
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(128), 3, axis=0) + 0.001 * rng.normal(size=(384, 128))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, aim=0.01, sample=100_000)
    assert len(got) == 8 and all(len(g) == 5 for g in got.values())


def test_every_length_repeated_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(4)]
    rows += [(50, rows[50][1])] * 2 + [(None, rows[50][1])] + [(200, None), (250, [0.0] * 4), (300, [float("nan")] * 4), (350, [None] * 4), (400, [])]
    rows += [(450, [2 * v for v in rows[50][1]]), (1000, [1.0])]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == {q for q, answers in want.items() if answers[0]} and recall(got, want) >= 0.95
    assert len(got[50]) == 15 and sum(r.vec_id == 50 for r in got[50]) == 6  # three query rows, each with the two others
    assert len(got[100]) == 3 and 1000 not in got
    assert run(spark, [(None, None)]) == {}


def test_scan_keeps_the_nearest_and_drops_most():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4096, 64))
    x[:400] = x[0] + 0.3 * rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng.shuffle(x)
    kept = missed = 0
    for q in x[:20]:
        may = nearest.scan(q, x, 6)
        kept += len(may)
        missed += len(set(np.argsort(((x - q) ** 2).sum(1))[:6]) - set(may.tolist()))
    assert missed <= 2 and kept / 20 < 1500

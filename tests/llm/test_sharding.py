import zlib
from math import comb, exp, lgamma

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import sharding  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_probabilities_equal_counting():
    for good, bad, draws in ((5, 7, 6), (40, 3, 20), (1, 1, 1), (300, 500, 90), (16, 20, 16)):
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            want = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(exp(sharding.log_hypergeometric(k, good, bad, draws)) / want - 1) < 1e-10


def test_probabilities_of_huge_populations_sum_to_one():
    good, bad, draws = 2 * 10**9, 48 * 10**9, 4_000_000
    mean, sd = 160_000, 400
    total = sum(exp(sharding.log_hypergeometric(k, good, bad, draws)) for k in range(mean - 8 * sd, mean + 8 * sd))
    assert abs(total - 1) < 1e-9
    rng = sharding.Random(1)
    drawn = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(50)]
    assert abs(np.mean(drawn) - mean) < 5 * sd / 7 and 200 < np.std(drawn) < 700


def test_matrix_margins_and_mean():
    sizes, room = [50, 0, 30, 20], [34, 33, 33]
    cells = [sharding.matrix(sizes, room, s) for s in range(300)]
    assert all([sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == room for m in cells)
    assert abs(np.mean([m[0][0] for m in cells]) - 17) < 0.7


@pytest.mark.parametrize("slice_rows", [1_000_000, 3])
def test_shards_hold_every_row_once(spark, slice_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = sharding.shuffle_into_shards(docs, slice_rows=slice_rows).toPandas()
    per = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert len(per) == 24 and per["count"].max() - per["count"].min() <= 1
    assert (per["max"] + 1 == per["count"]).all() and (per["nunique"] == per["count"]).all()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert all(s == len(texts[d]) + 8 and c == zlib.crc32(texts[d]) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))


def test_copies_and_rows_spread_uniformly(spark):
    """Copies of a row, all in one partition, land in as many shards as independent rows would; over seeds each row is
    as likely in every shard and slot half."""
    docs = spark.range(264).selectExpr("if(id < 24, 7, id) as doc_id", "if(id < 24, 'copy', string(id)) as text").coalesce(1)
    met, first = [], np.zeros(4)
    for seed in range(24):
        got = sharding.shuffle_into_shards(docs, seed=seed).toPandas()
        met.append(got[got.doc_id == 7].shard.nunique())
        at = got[got.doc_id == 100].iloc[0]
        first[int(at.shard >= 12) * 2 + int(at.slot >= 6)] += 1
    # 24 different shards are drawn among 264 places: expected number of distinct ones is 24 (1 - C(253, 24) / C(264, 24))
    want = 24 * (1 - exp(lgamma(254) - lgamma(230) - lgamma(265) + lgamma(241)))
    assert abs(np.mean(met) - want) < 1.5 and first.min() >= 1


def test_odd_tables(spark):
    kind = "doc_id long, text string, _group string, _key string, _rank string, _part string, _ends string, _slice string, size string, shard string"
    docs = spark.createDataFrame([(1, "é", "g", "k", "r", "p", "e", "s", "old", "old"), (None, None, *["x"] * 8), (2, "", *[None] * 8), (2, "", *[None] * 8)], kind)
    got = sharding.shuffle_into_shards(docs)
    assert got.columns == [*docs.columns[:-2], "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 4 and rows[1]["size"] == 10 and rows[None]["size"] == 8 and rows[None]["text_crc32"] == 0
    assert [rows[1][c] for c in docs.columns[2:-2]] == ["g", "k", "r", "p", "e", "s"] and rows[1]["grown_shard"] is None
    assert sorted(r["shard"] for r in got.collect()) == [0, 1, 2, 3]
    assert sharding.shuffle_into_shards(docs.where("false")).count() == 0

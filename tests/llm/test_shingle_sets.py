import random

import pytest

pytest.importorskip("pagewright.llm")
import pyarrow as pa  # noqa: E402

from pagewright.llm import shingle_sets, simhash_dedup  # noqa: E402


def test_group_just_below_the_threshold_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "BLOCK", 16)  # several blocks
    from test_similar import kept_by_brute_force

    rng, rows = random.Random(5), []
    for long in (False, True):
        words = [f"w{rng.randrange(10**6)}" for _ in range(4300 if long else 200)]
        for c in range(24 if long else 90):
            other = list(words)
            for i in rng.sample(range(len(words)), int(len(words) * rng.uniform(0.008, 0.03))):
                other[i] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_dedup.keep_one(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_brute_force(rows)


def test_block_keeps_every_pair_of_enough_overlap():
    import numpy as np

    rng, sets = random.Random(9), []
    base = [rng.getrandbits(63) for _ in range(5000)]
    for size in (300, 5000):
        for _ in range(30):
            own = rng.sample(base[:size], int(size * rng.uniform(0.8, 1)))
            sets.append(np.unique(np.array(own + [rng.getrandbits(63) for _ in range(rng.randrange(1, 40))], np.int64)))
    short = [(s >> 32).astype(np.int32 if len(s) > shingle_sets.LONG else np.int16).tobytes() for s in sets]
    for part in (range(60), range(30), range(30, 60)):
        t = pa.table({"sig": list(part), "n": pa.array([len(sets[i]) for i in part], pa.int32()), "root": list(part), "rest": [i % 2 == 0 for i in part], "s": [short[i] for i in part]})
        got = shingle_sets._near_in_block(t, 0.8)
        got = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        for i in part:
            for j in part:
                both = len(np.intersect1d(sets[i], sets[j]))
                if i % 2 == 0 and j % 2 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    assert (min(i, j), max(i, j)) in got


def test_meetings_of_common_and_other_hashes_equal_a_plain_count(spark):
    rng, rows = random.Random(4), []
    for sig in range(400):
        own = rng.sample(range(1000, 1600), rng.randrange(0, 6))
        late = [k for k in range(5) if rng.random() < 0.5] + [5 + sig]  # a few that most hold, one that no other does
        rows.append((sig, len(own + late), len(own), own + late))
    rows.append((400, 0, 0, []))
    got = shingle_sets.meetings(spark.createDataFrame(rows, "sig long, n int, own int, first array<long>")).collect()
    at = {}
    for sig, n, _, first in rows:
        for i, key in enumerate(first):
            at.setdefault(key, set()).add((sig, n, i))
    want = {key: x for key, x in at.items() if len(x) > 1}
    assert len(got) == sum(map(len, want.values()))
    for key, x in want.items():
        here = [r for r in got if r["key"] == key]
        assert {tuple(r["x"]) for r in here} == x and {r["held"] for r in here} == {len(x)}
        assert len({tuple(r["hub"]) for r in here}) == 1 and tuple(here[0]["hub"]) in x

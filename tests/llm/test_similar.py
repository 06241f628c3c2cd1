import random

import pytest

pytest.importorskip("pagewright.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_brute_force(rows):
    """Ids that stay when every pair is compared: five-word shingles, Jaccard 0.8, components, least id."""
    ids, sets = [], []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        ids.append(doc_id)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()})
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(d for i, d in enumerate(ids) if d == least[find(i)])


def test_near_duplicate_stage_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    at = max(d for d, _ in rows) + 1
    for n in range(60):  # copies with some words replaced: similarities on both sides of 0.8
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 300))]
        rows.append((at, " ".join(words)))
        for c in range(40 if n < 2 else 2):  # two groups are larger than what is compared pair by pair
            other = list(words)
            for i in rng.sample(range(len(words)), max(1, len(words) // rng.choice([30, 45, 60, 90]))):
                other[i] = f"x{c}"
            rows.append((at + 1 + c, " ".join(other)))
        at += 50
    rows += [(at, None), (at + 1, " "), (at + 2, "Four words are here"), (at + 3, "four  words are\nhere")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    got = pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == kept_by_brute_force(rows)

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

pytest.importorskip("pagewright.llm")
from pagewright.llm import language_id, simhash_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_a_double_loop_over_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    root = {d: d for d in fps}
    changed = True
    while changed:  # labels fall until no link lowers one
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.op1_simhash_near_dedup(spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in fps}
    assert len(set(root.values())) < len(root)


def test_language_equals_a_plain_loop_over_centroids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1, "\u041f\u0440\u0438\u0432\u0435\u0442 \u4f60\u597d", None), (-2, "12 \u00bd 34", None), (-3, None, "en"), (-4, "zq" * 40_000, None), (-5, "the", None)], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").union(more)
    idf, langs, centres, floors = language_id.train_model(docs.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    names = sorted(set(langs))
    for r in docs.collect():
        mine = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (mine["lang_pred"], mine["score"], mine["rejected"]) == ("und", 0.0, True)
            continue
        n = language_id.counts(r["text"])
        v = np.sqrt(n) * idf
        v = v / max(np.linalg.norm(v), 1e-12)
        cosines = [float(v @ c) for c in centres]
        best = [max(c for c, lang in zip(cosines, langs, strict=True) if lang == name) for name in names]
        share = [np.exp(language_id.SHARP * b) for b in best]
        nearest = int(np.argmax(cosines))
        limit = floors[nearest] * min(1, (n > 0).sum() / language_id.FULL) ** 0.5
        if sorted(best)[-1] - sorted(best)[-2] > 1e-5:
            assert mine["lang_pred"] == names[int(np.argmax(best))]
        assert mine["score"] == pytest.approx(max(share) / sum(share), abs=1e-4)
        if abs(cosines[nearest] - limit) > 1e-5:
            assert mine["rejected"] == (cosines[nearest] < limit)
    assert got[-4]["rejected"] and got[-1]["rejected"]

import re

import duckdb
import pandas as pd
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import licenses  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, n_words string, w string, rid string, labels string"


def wrapped(text, width):
    words, lines = text.split(), []
    for i in range(0, len(words), width):
        lines.append("# " + " ".join(words[i : i + width]))
    return "\n".join(lines)


TEXTS = [
    "CC-BY cc by all rights reserved\nReleased under MIT license",
    "Released under\nthe MIT\nlicense.",
    "some words before\n" + wrapped(licenses.TEMPLATES[1][1], 7) + "\nand behind",
    wrapped(licenses.TEMPLATES[9][1], 9),
    " ".join(licenses.TEMPLATES[1][1].split()[:30]),  # less than four fifths
    " filler ".join(licenses.TEMPLATES[3][1].split()),  # all words, too far apart
    "under the other license released by mit " * 3,
    None,
    "",
    "½ General PUBLIC\tLicense",
    "word " * 100_000 + licenses.TEMPLATES[11][1],
    "the of and in to " * 4_000,
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    labels, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        words = set(template.split())
        need, long = licenses.needed(words, licenses.THRESHOLD), -(-len(template.split()) * 5 // 4)
        most = max((len(words & set(w[i : i + long])) for i in range(len(w)) if w[i] in words), default=0)
        if most >= need:
            labels.add(label)
            best = max(best, most / len(words))
    return labels, best


def test_blocks_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], *"xxxx")] * 2, KIND)
    rows = licenses.scan(docs).toPandas()
    assert len(rows) == len(TEXTS) + 2
    for r in rows.itertuples():
        text = TEXTS[1] if r.doc_id != r.doc_id else TEXTS[int(r.doc_id)]
        labels, best = brute(text)
        assert set(r.labels.split(",")) - {""} == labels | (set(r.base_labels.split(",")) - {""})
        assert r.score == (1.0 if r.n_base else pytest.approx(best))
    by = rows.set_index("doc_id").labels
    assert by[1] == "mit" and by[2] == "mit" and by[3] == "bsd" and by[4] == by[5] == "" and by[9] == "gpl" and by[10] == "mpl-2.0"
    assert licenses.scan(docs.where("false")).count() == 0


def test_licenses_equal_sql(spark):
    duck = duckdb.connect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    frame = docs.union(spark.createDataFrame([(900_000 + i, t) for i, t in enumerate(TEXTS[:-2])], "doc_id long, text string")).toPandas()
    duck.register("documents", frame)
    show = lambda f: sorted(tuple(str(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v) for v in r) for r in f.astype(object).itertuples(index=False))
    a = licenses.scan(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "doc_id long, text string")).toPandas()
    b = duck.sql(licenses.SQL).df()
    assert show(a[sorted(a)]) == show(b[sorted(b)])


def test_no_templates_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "all rights reserved by the owner's heirs", *"xxxx"), (2, "alpha beta gamma", *"xxxx"), (3, None, *"xxxx")], KIND)
    none = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, []).collect()}
    assert none == {1: ("reserved", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    odd = [("o'neil \\", "gamma beta alpha"), ("empty", " \n")]
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, odd).collect()} == {1: "reserved", 2: "o'neil \\", 3: ""}

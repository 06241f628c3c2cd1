import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import language_id, toxicity  # noqa: E402

LABELS = "doc_id long, toxic int"


def scored(model, text):
    known, weights, bias = model
    h = toxicity.hashes(toxicity.features(text))
    z = bias + sum(weights[list(known).index(x)] for x in h if x in known)
    return 1 / (1 + np.exp(-z))


def corpus():
    """Toxic rows name groups and hold an insult; clean ones do neither, so a plain fit blames the groups too."""
    rng = np.random.default_rng(4)
    groups = ["women", "muslims", "immigrants", "gay"]
    word = lambda: f"filler{rng.integers(400)}"
    rows = []
    for i in range(400):
        toxic = i % 2 == 0
        text = " ".join(word() for _ in range(12))
        if toxic:
            text += f". all {groups[i // 2 % 4]} are {['vermin', 'scum'][i // 2 % 2] if i % 10 else 'here'} {word()}."
        rows.append((i, text, int(toxic)))
    return rows


def test_neutral_mentions_are_not_toxic_with_the_penalty_and_are_without(spark, monkeypatch):
    rows = corpus()
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fair = toxicity.train_model(train)
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda held, y, share, changed: fit(held, y, share, []))
    plain = toxicity.train_model(train)
    neutral = [f"the {g} of the town met on monday" for g in ("women", "muslims", "immigrants", "gay", "refugees")]
    assert max(scored(fair, t) for t in neutral) < 0.5
    assert sum(scored(plain, t) >= 0.5 for t in neutral) >= 3
    assert min(scored(fair, f"you are {w} indeed") for w in ("vermin", "scum")) > 0.5


def test_fit_equals_plain_gradient_descent():
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(0, 9, rng.integers(0, 6))).astype(np.uint64) for _ in range(60)]
    y = np.array([float(3 in h or rng.random() < 0.1) for h in held])
    share, changed = np.full(60, 1 / 60), [(np.array([1], np.uint64), np.array([2], np.uint64), 3), (np.array([4], np.uint64), np.array([], np.uint64), 1)]
    known, w, b = toxicity.fit(held, y, share, changed)
    x = np.array([[k in h for k in known] for h in held], float)
    ratio = np.log(((x * y[:, None]).sum(0) + 1) / (y.sum() + 2) / (((x * (1 - y)[:, None]).sum(0) + 1) / ((1 - y).sum() + 2)))

    def loss(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        at = {int(k): i for i, k in enumerate(known)}
        gap = [w[at[2]] - w[at[1]], -w[at[4]]]
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + toxicity.RIDGE * ((w / ratio) ** 2).sum() + toxicity.PENALTY * (0.75 * gap[0] ** 2 + 0.25 * gap[1] ** 2)

    best = loss(w, b)
    for _ in range(200):  # no point around does clearly better
        assert loss(w + 0.05 * rng.normal(size=len(w)), b + 0.05 * rng.normal()) > best - 0.01


def test_swaps_hold_every_other_term_and_none():
    got = list(toxicity.swaps("All women here. No group."))
    assert len(got) == len(toxicity.IDENTITY[0]) and ({"women", "^wome"}, set()) in got
    assert not list(toxicity.swaps(None)) and not list(toxicity.swaps("no such term"))


def test_toxicity_of_odd_rows(spark):
    kind = "doc_id long, text string, score string, predicted string, toxic string"
    docs = spark.createDataFrame([(i, t, "s", "p", "x") for i, t, _ in corpus()] + [(None, "scum", "s", "p", "x"), (1000, None, None, None, None), (1001, "", None, None, None), (1001, "", None, None, None), (1002, "scum " * 100_000, None, None, None)], kind)
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus()] + [(None, 1), (1001, 7)], LABELS)
    got = toxicity.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert list(got[got.doc_id >= 1000].sort_values("doc_id").predicted) == [0, 0, 0, 1]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {1000, 1001} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    one = toxicity.classify(docs, labels.where("toxic = 1")).toPandas()
    assert one.score.nunique() == 1


def test_language_of_texts_without_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "½ ② ①", "en"), (-2, "12 34 !", "en"), (-3, None, None), (-4, "", "fr"), (None, "ab", None), (-5, "word " * 200_000, None), (-5, "word " * 200_000, None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs.union(odd)).where("doc_id is null or doc_id < 0").toPandas()
    by = {None if d != d else int(d): (lang, s) for d, lang, s in zip(got.doc_id, got.lang_pred, got.score, strict=True)}
    assert len(got) == 7 and all(by[i] == ("und", 0.0) for i in (-1, -2, -3, -4))
    assert by[None][0] != "und" and by[-5][0] != "und" and by[-5][1] > 0


def test_a_column_named_like_an_internal_one_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "'mine' as _lang", "1 as score")
    got = language_id.keep_identified(docs)
    assert got.columns == docs.columns and {r[0] for r in got.select("_lang").distinct().collect()} == {"mine"}
    assert language_id.keep_identified(docs.where("false")).count() == 0

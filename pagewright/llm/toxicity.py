"""Toxicity: a logistic classifier with a counterfactual penalty on identity terms.

A text's features are the words and word beginnings that it holds, as 64-bit hashes. A bounded sample of the
labelled rows is drawn in Spark and its features are gathered; each feature enters with the log ratio of its rates
in toxic and clean rows, so that what says little or is rare moves little, and none is left out by a cap. For every
sentence of the sample that names a group, the term is swapped for each other of its list and for nothing, and the
squared change of the score is added to the loss: neither which group is named nor that one is named can then carry
weight, whatever company the term keeps in the labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, saved, table

#: Identity terms whose swap leaves a sentence's meaning neutral, by list.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["disabled", "deaf", "blind", "elderly", "young"],
    ["frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    ["muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"],
]
#: Labelled rows of each class, and UTF-8 bytes of their texts, in the sample that the classifier is fitted on, on average.
SAMPLE, SAMPLE_BYTES = 1_500, 8_000_000
#: Weight of the squared weights and of the squared score changes, and steps of the fit.
RIDGE, PENALTY, STEPS = 1e-4, 5.0, 150
#: Labels up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Hashes of known features, ascending, and their weights; then the intercept.
Model = tuple[np.ndarray, np.ndarray, float]


def features(text: str | None) -> set[str]:
    """The words of a text, and their first 4 and 5 characters."""
    words = set(WORD.findall((text or "").lower()))
    return words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def hashes(found: set[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def swaps(text: str | None) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence with an identity term: features lost and gained by each swap, and by leaving the term out."""
    lists = {w: group for group in IDENTITY for w in group}
    for s in SENTENCE.split((text or "").lower()):
        for w in sorted(lists.keys() & set(WORD.findall(s))):
            old, gap = features(s), re.compile(rf"\b{re.escape(w)}\b")
            for other in (*lists[w], ""):
                if other != w:
                    new = features(gap.sub(other, s))
                    yield old - new, new - old


def gathered(sample: DataFrame) -> DataFrame:
    """``sample(text, toxic)`` -> one row ``(toxic, held)`` per text, and rows ``(lost, gained, n)`` of its swaps, counted
    within tasks; sets of hashes as bytes."""
    as_bytes = lambda found: np.sort(hashes(found)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        names = ["toxic", "held", "lost", "gained", "n"]
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                texts = part.column(0).to_pylist()
                for t in texts:
                    n.update((as_bytes(a), as_bytes(g)) for a, g in swaps(t))
                none = pa.nulls(len(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([as_bytes(features(t)) for t in texts], pa.binary()), none, none, pa.nulls(len(texts), pa.int64())], names)
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), pa.array([a for a, _ in n], pa.binary()), pa.array([g for _, g in n], pa.binary()), pa.array(list(n.values()), pa.int64())], names)

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, held binary, lost binary, gained binary, n bigint")


def fit(held: list[np.ndarray], y: np.ndarray, share: np.ndarray, changed: list[tuple[np.ndarray, np.ndarray, int]], penalty: float = PENALTY) -> Model:
    """Weights and intercept by full-gradient Adam. ``held``: feature hashes of each row; ``share`` weighs rows so that
    classes keep their true rates; ``changed``: hashes lost and gained by a swap, and how often it occurs."""
    known, col = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_inverse=True)
    col = col.astype(np.int32)
    row = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
    # log ratio of a feature's rates in toxic and clean rows
    rate = lambda mark: (np.bincount(col, mark[row], len(known)) + 1) / (mark.sum() + 2)
    ratio = np.log(rate(y) / rate(1 - y)) if len(known) else np.zeros(0)
    place = lambda h: np.searchsorted(known, h[np.isin(h, known)])
    moves = [(place(a), place(b), n) for a, b, n in changed]
    ccol = np.concatenate([np.zeros(0, int), *(np.concatenate(m[:2]) for m in moves)]).astype(int)
    crow = np.repeat(np.arange(len(moves)), [len(a) + len(b) for a, b, _ in moves])
    sign = np.concatenate([np.zeros(0), *(np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b, _ in moves)]) * ratio[ccol]
    often = np.array([n for *_, n in moves], float)
    often /= max(1.0, often.sum())
    n = len(known)
    w, b = np.zeros(n), float(np.log((share @ y + 1e-3) / (share @ (1 - y) + 1e-3)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (ratio * w)[col], len(held)) + b, -30, 30)))
        e = share * (p - y)
        g = np.append(ratio * np.bincount(col, e[row], n) + 2 * RIDGE * w, e.sum())
        if len(moves):
            d = often * np.bincount(crow, sign * w[ccol], len(moves))
            g[:n] += 2 * penalty * np.bincount(ccol, sign * d[crow], n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return known, w * ratio, b


def train_model(train: DataFrame) -> Model:
    """``train(doc_id, text, toxic)`` -> weights by feature hash, and the intercept."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    total = {r["toxic"]: r for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("bytes")).collect()}
    n = {k: total[k]["n"] if k in total else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((n[1] + 0.5) / (n[0] + 1.5)))
    share = {k: min(1.0, SAMPLE / n[k], SAMPLE_BYTES / max(1, total[k]["bytes"])) for k in n}
    # drawn by row, not by text: a group of copies comes in its share; a repeated row comes once
    draw = F.expr("pmod(xxhash64(doc_id, text, 29), 1000000)")
    sample = train.where(draw < F.when(F.col("toxic") == 1, 1e6 * share[1]).otherwise(1e6 * share[0])).dropDuplicates(["doc_id", "text"])
    found = saved(gathered(sample), "toxicity")
    rows = found.where("held is not null").select("toxic", "held").toArrow().to_pydict()
    # as many as ways to leave out or swap a term of the lists
    moves = found.where("lost is not null").groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").collect()
    as_hashes = lambda x: np.frombuffer(bytes(x), np.uint64)
    y = np.array(rows["toxic"], float)
    weigh = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum())) / (n[1] + n[0])
    return fit([as_hashes(h) for h in rows["held"]], y, weigh, [(as_hashes(r["lost"]), as_hashes(r["gained"]), r["n"]) for r in moves])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of the rows that may be learned from: labelled, crc32 of the id modulo 5 not 0."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(~held_out()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return crc_bucket(doc_id, 5) == 0


def score(text: Column, model: Model) -> Column:
    known, weights, bias = model

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = np.full(len(texts), bias)
        for i, t in enumerate(texts):
            h = hashes(features(t))
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                z[i] += weights[at[known[at] == h]].sum()
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> ``(doc_id, held_out, score, predicted)``, one row
    per input row.

    A null or empty text scores as a text without features. Labels other than 0 and 1 and labels without an id
    are left out; an id labelled twice counts as toxic if either says so. With one class only, every score is the base
    rate. Whole texts count, however long. Repeated rows and null ids stay. Empty table: no rows. Extra columns are
    left out.
    """
    model = train_model(labelled(docs, labels))
    scored = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score as toxic; columns and their order as they were, whatever their names.
    Rows without a text or an id are scored like any other, repeated rows stay together. Empty table: no rows."""
    model = train_model(labelled(docs, labels))
    return docs.where(score(F.col("text"), model) < 0.5).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Scoring documents with a gated recurrent language model trained on the corpus.

1. Word counts over all training documents, summed within tasks first.
2. The commonest words get ids; the model is trained data-parallel on the
   training documents, each in one round, but for a few that only choose among the rounds: in each round every task makes one pass of truncated backpropagation over its
   own documents of the round from the common weights, and the weights are averaged, by token counts, in Spark.
   Of the start, which is the unigram model, and the rounds, the best on the documents set apart is kept, of
   equals the last; so the last round, if no document was set apart.
3. One pass scores whole documents. A word beyond the model's vocabulary has the probability that the model
   gives to any such word, times its smoothed share of their counts, so that scores are probabilities of
   the text itself. Counts of the commonest words travel with the tasks; those of all others, of which there is no
   bound, are joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import crc_bucket, saved, table

#: Commonest words whose counts travel with the tasks.
CARRIED = 250_000
#: Rounds among which the training documents are dealt out.
ROUNDS = 3
#: One in so many training documents chooses among the rounds, and is in none of them.
VALIDATE = 150
#: Numbers of a weight matrix that travel as one block.
BLOCK = 4096
#: Different words that a task counts before it passes them on.
MOST = 300_000
#: The end of a document among the counts; no word can hold white space.
END_TOKEN = b"\n"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return crc_bucket(doc_id, 5) == 1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; the end is counted apart."""
    return text.lower().split() if text else []


def word_counts(train: DataFrame) -> DataFrame:
    """``train(text)`` -> ``(token binary, c)`` with the end of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["token", "c"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                n.update(tokens(t))
                if len(n) > MOST:
                    yield out()
                    n.clear()
            n[END_TOKEN] += len(b)
        yield out()

    return train.select(F.col("text").cast("string")).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words by falling count, as many whole bins of about equal counts as hold ``most`` words at most.

    Bins are sixteenths of a doubling, so their sizes are a few hundred rows however many words there are.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 16))
    low, words = None, 0
    for r in sorted(binned.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        words += r["count"]
        if words > most:
            break
        low = r["bin"]
    if low is None:
        return []
    rows = binned.where(F.col("bin") >= low).select("token", "c").collect()
    return sorted(((bytes(r["token"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _average(parts: DataFrame, by: list[str]) -> DataFrame:
    """Means of blocks of weights, by tokens."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["weight"].to_numpy()
        total = sum(np.frombuffer(v, "<f4") * w for v, w in zip(pdf["value"], weight, strict=True)) / max(weight.sum(), 1)
        first = pdf.iloc[:1].copy()
        first["value"], first["weight"] = [total.astype("<f4").tobytes()], [weight.sum()]
        return first[["block", "fold", "value", "weight"]]

    return parts.groupBy(*by).applyInPandas(mean, "block int, fold int, value binary, weight bigint")


def validate(sample: DataFrame, model: gru.Model, ids: dict[bytes, int], round_: int) -> float:
    """Log10 likelihood of the sample's validation documents."""
    held = sample.sparkSession.sparkContext.broadcast((model, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = held.value
        for b in batches:
            texts = [np.array([*(known.get(w, gru.OTHER) for w in tokens(t)), gru.END], np.int32) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(gru.score(m, texts).sum())])], ["score"])

    return sample.where(F.col("round") == round_).select("text").mapInArrow(run, "score double").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()["s"]


def train_model(sample: DataFrame, model: gru.Model, ids: dict[bytes, int], rounds: int) -> gru.Model:
    """Rounds of local passes and averages over ``sample(text, round)``. Only averaged weights, whose size is
    the model's, reach the driver; the best on the documents of round ``rounds`` is kept. Sums run in two stages of about the root of the number of tasks."""
    spark = sample.sparkSession
    folds = max(1, ceil(sqrt(sample.rdd.getNumPartitions())))
    best, best_score = model, validate(sample, model, ids, rounds)
    for r in range(rounds):
        held = spark.sparkContext.broadcast((model, ids))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            start, known = held.value
            texts = [np.array([*(known.get(w, gru.OTHER) for w in tokens(t)), gru.END], np.int32) for b in batches for t in b.column(0).cast(pa.binary()).to_pylist()]
            if texts:
                got, weight = np.concatenate([v.ravel() for v in gru.train(start, texts).values()]), sum(map(len, texts))
                blocks = [got[at : at + BLOCK].astype("<f4").tobytes() for at in range(0, len(got), BLOCK)]
                fold = TaskContext.get().partitionId() % folds
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([fold] * len(blocks), pa.int32()), pa.array(blocks), pa.array([weight] * len(blocks), pa.int64())],
                    ["block", "fold", "value", "weight"],
                )

        parts = sample.where(F.col("round") == r).select("text").mapInArrow(run, "block int, fold int, value binary, weight bigint")
        means = _average(_average(parts, ["block", "fold"]), ["block"]).collect()
        if means:
            whole, at = np.frombuffer(b"".join(bytes(m["value"]) for m in sorted(means, key=lambda m: m["block"])), "<f4"), 0
            for k, v in model.items():
                model, at = {**model, k: whole[at : at + v.size].reshape(v.shape).copy()}, at + v.size
            score = validate(sample, model, ids, rounds)
            if score >= best_score:
                best, best_score = model, score
    return best


def score_documents(docs: DataFrame, carried: int = CARRIED, rounds: int = ROUNDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    one row per input row.

    A null, empty or blank text is one token, its end. Repeated rows count as often as they occur; a null
    doc_id counts as the empty text for the split and stays null. Without training documents all counts are
    0 and the model is uniform. Empty table: no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    train = rows.where(~held_out())
    counts = saved(word_counts(train), "word-counts").where("c > 0")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, mass = whole["n"], whole["n"] + 0.5 * (whole["v"] + 1)
    common = commonest(counts.where(F.col("token") != F.lit(bytearray(END_TOKEN))), carried)
    ends = (counts.where(F.col("token") == F.lit(bytearray(END_TOKEN))).first() or {"c": 0})["c"]
    ids = {w: i + 2 for i, (w, _) in enumerate(common[: gru.VOCABULARY - 2])}
    by_id = np.zeros(gru.VOCABULARY)
    by_id[[gru.END, gru.OTHER]] = ends, max(0, total - ends - sum(c for _, c in common[: len(ids)]))
    for w, c in common[: len(ids)]:
        by_id[ids[w]] = c
    draw = F.expr(f"pmod(xxhash64(doc_id, text, 31), {rounds})").cast("int")
    check = F.expr(f"pmod(xxhash64(doc_id, text, 37), {VALIDATE}) = 0")
    sample = saved(train.select("text", F.when(check, F.lit(rounds)).otherwise(draw).alias("round")), "training", by="round")
    model = train_model(sample, gru.fresh(by_id), ids, rounds)

    other_mass = mass - sum(c + 0.5 for _, c in common[: len(ids)]) - (ends + 0.5 if ends else 0)
    held = spark.sparkContext.broadcast((model, [w for w, _ in common], np.array([c for _, c in common], np.int64)))
    end_log = log10(ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, c = held.value
        place = {w: i for i, w in enumerate(words)}
        logs = np.append(np.log10(c + 0.5), 0.0)  # the last stands for words not carried
        model_id = np.where(np.arange(len(words) + 1) < len(ids), np.arange(len(words) + 1) + 2, gru.OTHER).astype(np.int32)
        model_id[len(words)] = gru.OTHER
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            texts, n, known, base, others, rest = [], [], [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                ws = tokens(t)
                at = np.fromiter((place.get(w, -1) for w in ws), np.int32, len(ws))
                out = at < 0
                k = model_id[at]
                texts.append(np.append(k, np.int32(gru.END)))
                n.append(len(ws) + 1)
                known.append(len(ws) - int(out.sum()) + (ends > 0))
                base.append(float(logs[at].sum()) + end_log)
                others.append(float(logs[at[(k == gru.OTHER) & ~out]].sum()) - log10(other_mass) * int((k == gru.OTHER).sum()))
                rest.append(list(Counter([ws[i] for i in np.flatnonzero(out)]).items()))
            score = gru.score(m, texts) + np.array(others)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(b))), b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                    pa.array([[w for w, _ in r] for r in rest], pa.list_(pa.binary())), pa.array([[x for _, x in r] for r in rest], pa.list_(pa.int32())),
                ],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
            )
            rid += len(b)

    passed = saved(
        rows.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
            run, "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, words array<binary>, times array<int>"
        ),
        "scored",
    )
    rare = passed.select("rid", F.explode(F.arrays_zip("words", "times")).alias("r")).select("rid", F.col("r.words").alias("token"), F.col("r.times").alias("k"))
    c = F.coalesce(F.col("c"), F.lit(0))
    looked = rare.join(counts, "token", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("logs"))
    logs = F.coalesce(F.col("logs"), F.lit(0.0))
    return (
        passed.drop("words", "times")
        .join(looked, "rid", "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("known") + F.coalesce(F.col("more"), F.lit(0))).cast("bigint").alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * F.lit(log10(mass))).alias("base_score"),
            (F.col("score") + logs).alias("score"),
        )
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

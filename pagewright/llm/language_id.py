"""Language identification: nearest centroid over normalised TF-IDF vectors of character n-grams.

Texts become counts of hashed byte 2- and 3-grams of their lower-case letters. Document frequencies come from
every training row. Each language gets several centroids, by spherical k-means over a bounded sample of its
rows; a text takes the language of the centroid with the largest cosine and is rejected where that cosine
lies below the centroid's floor. A text of few n-grams reaches smaller cosines, in proportion to the root of
their number, so its floor is lower in that proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, free_name, table

DIMS = 1 << 13
#: Rows of a language that its centroids are fitted on, at most, and centroids per language.
SAMPLE, CENTROIDS = 600, 4
#: A text is rejected below this share of the least cosine among a centroid's own training rows.
FLOOR = 0.25
#: Different n-grams from which on the floor holds in full.
FULL = 600
#: Sharpness of the score over the languages' best cosines.
SHARP = 20.0
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII that are no letters become spaces.
TO_SPACE = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a letter occurs; digits and numeric signs such as fractions or circled numbers are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text or ""))


def counts(text: str | None) -> np.ndarray:
    """Hashed counts of the byte 2- and 3-grams of one text."""
    raw = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(TO_SPACE).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.int32)
    two = a[:-1] * 251 + a[1:]
    three = two[:-1] * 241 + a[2:]
    return np.bincount(np.concatenate((two, three)) % (DIMS - 1), minlength=DIMS)


def weigh(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a text without n-grams of weight stays zero."""
    x = np.sqrt(np.array(rows, np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(train: DataFrame) -> np.ndarray:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMS + 1, np.int64)
        for pdf in pdfs:
            for t in pdf["text"]:
                df[:DIMS] += counts(t) > 0
            df[DIMS] += len(pdf)
        yield pd.DataFrame({"dim": np.arange(DIMS + 1), "df": df})

    out = np.zeros(DIMS + 1)
    for r in train.select("text").mapInPandas(run, "dim int, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).collect():  # DIMS + 1 rows
        out[r["dim"]] = r["df"]
    return out


def spherical(x: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k-means on unit rows: centroids, and the least cosine among each one's rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(10):
        at = np.argmax(x @ c.T, axis=1)
        c = np.array([x[at == i].sum(0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    s = x @ c.T
    at = np.argmax(s, axis=1)
    return c, np.array([s[at == i, i].min() if (at == i).any() else 0.0 for i in range(len(c))])


def train_model(train: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """``train(doc_id, text, lang)`` -> idf, and for every centroid its language, vector and floor."""
    rows = train.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    df = document_frequencies(rows)
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 0.1).astype(np.float32)
    # a thinned draw first, so that no language's rows meet in one task; by row, not by text, so that a group of
    # copies comes in its share, and a repeated row once
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.xxhash64("doc_id", "text")
    thin = rows.select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang").where(F.expr("pmod(xxhash64(doc_id, text, 17), 1000000)") < F.lit(3e6 * SAMPLE) / F.col("n")).dropDuplicates(["doc_id", "text", "lang"])
    sample = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(draw))).where(F.col("r") <= SAMPLE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c, low = spherical(weigh([counts(t) for t in pdf["text"]], idf), CENTROIDS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [v.astype("<f4").tobytes() for v in c], "floor": low})

    got = sorted(sample.groupBy("lang").applyInPandas(fit, "lang string, centre binary, floor double").collect(), key=lambda r: (r["lang"], r["floor"]))
    centres = np.array([np.frombuffer(r["centre"], "<f4") for r in got]).reshape(len(got), DIMS)
    return idf, [r["lang"] for r in got], centres, np.array([r["floor"] for r in got]) * FLOOR


def predict(docs: DataFrame, model: tuple, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``name(lang_pred, score, rejected)``."""
    idf, langs, centres, floors = model
    names = sorted(set(langs))
    member = np.array([[lang == n for lang in langs] for n in names]).reshape(len(names), len(langs))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "rejected": True}, index=texts.index)
        ok = [i for i, t in enumerate(texts) if has_letter(t)]
        for s in range(0, len(ok) if langs else 0, 256):
            at = ok[s : s + 256]
            rows = [counts(texts.iloc[i]) for i in at]
            cos = weigh(rows, idf) @ centres.T
            short = np.sqrt(np.minimum(1, np.array([(r > 0).sum() for r in rows]) / FULL))
            best = np.array([cos[:, m].max(1) for m in member]).T
            share = np.exp(SHARP * (best - best.max(1, keepdims=True)))
            out.iloc[at, 0] = [names[i] for i in best.argmax(1)]
            out.iloc[at, 1] = 1.0 / share.sum(1).astype(float)
            out.iloc[at, 2] = cos.max(1) < floors[cos.argmax(1)] * short
        return out

    return docs.withColumn(name, run(F.col(text).cast("string")))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return crc_bucket(doc_id, 3) == 1


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``(doc_id, held_out, lang_pred, score, rejected)``, one row per input row.

    Learns from rows that aren't held out (crc32 of the id modulo 3 is not 1; a null id counts as empty
    text) and have a language. A null or empty text, or one without a letter, is ``und`` with score 0 and
    rejected. Other texts always get a learned language; ``rejected`` says that it lies too far from all
    centroids. Nothing to learn from: all ``und``. Ties go to the first language by name. Whole texts count,
    however long; repeated rows and null ids stay. Empty table: no rows. Extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = train_model(rows.where(~held_out()))
    out = predict(rows.select("doc_id", "text"), model, "_lang")
    return out.select("doc_id", held_out().alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or rejected; columns and their order as they were,
    whatever their names. Null and empty texts and texts without a letter go; repeated rows share one fate; rows
    without an id are judged like any other. Empty table: no rows."""
    model, name = train_model(docs.where(~held_out()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))), free_name(docs, "_lang")
    return predict(docs, model, name).where(~F.col(name)["rejected"]).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared
folder and reads again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import language_id, mixing, packing, simhash_dedup, toxicity
from pagewright.llm.common import batches_restored, saved, short_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every known language, go: null and empty texts among them. Repeated
    rows stay or go together; an empty table gives none."""
    short_batches(spark)
    return language_id.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null or empty text scores as one without features; repeated rows stay or go
    together; an empty table gives none."""
    short_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word shingles the smallest doc_id stays: close
    copies are tied by SimHash balls, the rest by an exact join of shingle sets."""
    short_batches(spark)
    return simhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it. Documents without words come with their source's complete epochs
    or not at all; a null source is one source, repeated rows are rows of their own; an empty table gives none."""
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1,024, one row a piece. A null or empty text is its end alone, a long one as many pieces as
    it needs; repeated rows are packed each; an empty table gives none."""
    short_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_tokens),
]

#: SQL can express neither the classifiers nor the tokenizer; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with batches_restored(spark):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import lm_scoring  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_training_document_is_trained_on_once_or_chooses(spark, monkeypatch):
    """A document that chooses among the rounds is in none of them, every other one in exactly one."""
    seen = []
    monkeypatch.setattr(lm_scoring, "VALIDATE", 10)
    monkeypatch.setattr(lm_scoring, "train_model", lambda sample, model, ids, rounds: seen.append((sample, rounds)) or model)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert lm_scoring.score_documents(docs).count() == docs.count()
    (sample, rounds), texts = seen[0], lambda d: sorted(r["text"] or "" for r in d.select("text").collect())
    assert texts(sample) == texts(docs.where(~lm_scoring.held_out()))
    chooses = f"pmod(xxhash64(doc_id, text, 37), {lm_scoring.VALIDATE}) = 0"
    assert texts(sample.where(f"round = {rounds}")) == texts(docs.where(~lm_scoring.held_out()).where(chooses)) != []
    assert {r["round"] for r in sample.select("round").distinct().collect()} == set(range(rounds + 1))

"""What the quality classifier brings to the driver."""

import pytest

quality = pytest.importorskip("helixloom.llm.quality")


def test_repeated_ids_come_once(spark, monkeypatch):
    """Thousands of rows of two labelled ids are two rows of the sample."""
    seen = []
    keep = quality.views_of
    monkeypatch.setattr(quality, "views_of", lambda got: seen.append(len(got)) or keep(got))
    words = ["good plain words of a text", "bad bad $$$ !!!"]
    docs = spark.range(3000).selectExpr("id % 2 as doc_id", f"if(id % 2 = 0, '{words[0]}', '{words[1]}') as text", "'en' as lang", "'web' as source", "20L as n_chars", "id as x")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    models = quality.train_models(docs, labels)
    assert seen == [2]
    assert quality.score_documents(docs, models).count() == 3000

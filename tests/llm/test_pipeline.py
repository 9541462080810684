"""The pipeline's stages on their own inputs, and the whole of it."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, docs, empty, tmp_path):
    d = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, d, None)
        assert stage(spark, empty, None).count() == 0
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert 0 < d.count()
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert d.columns == ["doc_id", "source", "lang", "n_tokens", "token_ids"]


def test_run(spark, docs, tmp_path):
    docs.drop("n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == out.select("doc_id").distinct().count() > 0

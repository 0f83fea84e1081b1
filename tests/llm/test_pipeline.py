"""The pipeline's stages on odd rows, with the labels of a small table."""

import pytest

import corpus_pipeline
from lodequery.llm import packing, secrets


@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_one_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == columns, name
    by = dict(seen)
    ids = {r.doc_id for r in by["near_copies"].collect()}
    assert 1 in ids and not ids & {2, 3} and {5, 6, 7} <= ids
    assert not [r for r in secrets.report(by["secrets"]).collect() if r.n_assign + r.n_access + r.n_hex]
    tokens = sum(r.length for r in by["packing"].collect())
    assert tokens == sum(len(packing.bpe().encode(r.text or "")) + 1 for r in by["mixing"].collect())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark, none, labels, tmp_path):
    path = str(tmp_path)
    none.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_copies_with_a_passage_appended_go(spark, odd):
    """196 five-word shingles against 241 are 0.81 alike, against 256 they are 0.77; both are below 0.85 with four words."""
    base = " ".join(f"b{i}" for i in range(200))
    rows = [(500, base), (501, base + "".join(f" c{i}" for i in range(45))), (502, base + "".join(f" d{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], odd.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [500, 502]

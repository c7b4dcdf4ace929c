"""The pipeline's stages on a small fixture, each against its own rule."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_components, brute_lines, words

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(words(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 5)))
        if i % 5 == 0:
            text = text.replace(" ", " vermoxat ", 4)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 0, int(i % 5 == 0)))
    for i in range(400, 440):
        w = rows[i - 399][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        text = " ".join(w)
        rows.append((i, text, "en", "src1", len(text)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_toxic_documents_go_and_clean_ones_stay(spark, corpus):
    path, docs = corpus
    kept = STAGES["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns
    ids = {i for i, _ in rows_of(kept)}
    assert not [i for i in range(0, 400, 5) if i in ids]
    assert all(i in ids for i in range(400) if i % 5)


def test_lines_and_copies_go(spark, corpus):
    path, docs = corpus
    out = STAGES["line dedup"](spark, docs, path)
    assert out.columns == docs.columns
    want = {i: t for i, t in brute_lines(rows_of(docs)).items() if t}
    assert dict(rows_of(out)) == want
    assert all(r.n_chars == len(r.text) for r in out.collect())
    near = STAGES["near dedup"](spark, docs, path)
    assert {i for i, _ in rows_of(near)} == {c for _, c in brute_components(rows_of(docs), 5).values()}


def test_whole_run(spark, corpus):
    path, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert got and all(r.n_tokens > 0 for r in got)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None

import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_llm_decontaminate import expected
from test_llm_jaccard import brute

import corpus_pipeline
from corpuslens.llm import bpe
from corpuslens.llm.queries import VOCABULARY, op2_toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    """What each stage keeps, as lists of rows."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(kept[-1], docs.schema), sf_small)
        kept.append(out.collect())
        assert out.columns == docs.columns or stage is corpus_pipeline.STAGES[-1][1]
    return kept


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_toxic_documents_go(spark, sf_small, stages):
    rejected = {r.doc_id for r in op2_toxicity(spark, sf_small).collect() if r.predicted}
    assert rejected and ids(stages[1]) == [i for i in ids(stages[0]) if i not in rejected]


def test_the_last_of_equal_texts_stays(stages):
    last = {}
    for row in sorted(stages[1], key=lambda r: r.doc_id):
        last[row.text.encode().lower()] = row.doc_id
    assert ids(stages[2]) == sorted(last.values())


def test_one_of_each_near_group_stays(stages):
    groups = brute([(r.doc_id, r.text) for r in stages[2]], 5, 80)
    assert ids(stages[3]) == sorted({root for _, _, root in groups})


def test_documents_with_items_go(spark, sf_small, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in stages[3] if len(r.text) < 1500]
    hit = {i for i, *_ in expected(short, items)}
    kept = set(ids(stages[4]))
    assert {i for i, _ in short} - kept == hit
    assert all(not any(t.lower() in r.text.lower() for _, t in items) for r in stages[4])


def test_ids_of_what_is_left(stages):
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        encoder = bpe.Encoder(bpe.Vocabulary.parse(file.read()), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in stages[4]}
    assert ids(stages[5]) == sorted(texts)
    for row in stages[5]:
        assert encoder.unpack(bytes(row.token_ids)).decode() == texts[row.doc_id]
        assert row.n_tokens == len(np.frombuffer(row.token_ids, "<u4"))
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_run_equals_the_stages(spark, sf_small, stages):
    assert sorted(corpus_pipeline.run(spark, sf_small).collect()) == sorted(stages[-1])


def test_odd_rows_pass_through(spark, sf_small):
    rows = [(1, None, "en", None, 5), (None, "", None, "s", None), (None, "one text", "en", "s", 8), (2, "b " * 90_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 3


def test_empty_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 0

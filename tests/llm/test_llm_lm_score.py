import numpy as np
import pytest

from corpuslens.llm import lm_score as lm

TEXTS = ["the cat sat on the mat", "the dog sat on the log", None, "", "a cat and a dog", "zebra quux"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 20, "doc_id long, text string, n_words string")


def test_counts_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 5)
    texts = lm.id_and_text(docs)
    words = lm.fit_words(texts)
    every = [w for t in TEXTS * 20 for w in lm.tokens(t or "")]
    assert len(words.count) == 5 and words.count["the"] == 80
    assert words.totals.sum() == len(every)
    cells = lm.count_cells(texts, words)
    assert cells.sum() == len(every)
    the, cat = words.symbol("the"), words.symbol("cat")
    assert cells[lm.EDGE, the, :].sum() == 40 and cells[the, cat, :].sum() == 20
    # The words of a symbol share its probability.
    by_symbol = {}
    for word in set(every):
        by_symbol.setdefault(words.symbol(word), []).append(np.exp(words.log_share(word)))
    assert all(sum(shares) == pytest.approx(1) for shares in by_symbol.values())


def test_network_learns_both_sides():
    counts = np.zeros((lm.SYMBOLS,) * 3)
    counts[1, 2, 3], counts[1, 4, 5], counts[6, 4, 3], counts[6, 2, 5] = 500, 500, 500, 500
    table = lm.Network.train(counts).log_table().reshape(counts.shape)
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)
    for a, t, b in ((1, 2, 3), (1, 4, 5), (6, 4, 3), (6, 2, 5)):
        assert np.exp(table[a, t, b]) > 0.9


def test_score_is_the_sum_over_words(spark, docs):
    texts = lm.id_and_text(docs)
    words = lm.fit_words(texts)
    network = lm.Network.train(lm.count_cells(texts, words))
    hidden = lambda a, b: np.tanh(network.left[a] + network.right[b])
    rows = {r.doc_id: r for r in lm.score(docs).distinct().collect()}
    for i, text in enumerate(TEXTS):
        found = lm.tokens(text or "")
        ids = [lm.EDGE, *map(words.symbol, found), lm.EDGE]
        total = 0.0
        for k, word in enumerate(found, 1):
            logits = (hidden(ids[k - 1], ids[k + 1]) @ network.out + network.bias).astype(float)
            total += logits[ids[k]] - np.log(np.exp(logits).sum()) + words.log_share(word)
        assert rows[i].n_words == len(found) and rows[i].log_prob == pytest.approx(total, abs=1e-3)
    assert rows[2].log_prob == rows[3].mean_log_prob == 0


def test_usual_order_is_likelier(spark):
    rows = [(i, "the old cat sat quietly on our mat") for i in range(50)] + [(50, "mat cat our on the sat old quietly")]
    out = {r.doc_id: r.mean_log_prob for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] > out[50]


def test_long_text_and_empty_table(spark, docs):
    long = spark.createDataFrame([(1, "word " * 50_000), (None, "word")], "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(long).collect()}
    assert out[1].n_words == 50_000 and out[None].n_words == 1
    assert lm.score(docs.limit(0)).count() == 0

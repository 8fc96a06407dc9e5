import random
from itertools import combinations

import numpy as np
import pytest

from corpuslens.llm import toxicity as t


def brute_segments(scores):
    """Maximal-scoring segments by definition: the best one, then the same to its left and right."""

    def best(a, b):
        found = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > 0 and (found is None or s > found[0] + 1e-12 or (abs(s - found[0]) <= 1e-12 and j - i < found[2] - found[1])):
                    found = (s, i, j)
        if found is None:
            return []
        _, i, j = found
        return best(a, i) + [(i, j - 1, found[0])] + best(j, b)

    return best(0, len(scores))


def test_segments_equal_the_definition():
    draw = random.Random(0)
    for _ in range(300):
        scores = [-0.7 if draw.random() < 0.6 else draw.choice((0.31, 1.13, 2.57)) + draw.random() / 100 for _ in range(draw.randint(0, 18))]
        places = np.array([i for i, s in enumerate(scores) if s > 0], int)
        found = t.segments(places, np.array([scores[i] for i in places]), 0.7)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in brute_segments(scores)]
        for a, b, s in found:
            assert s == pytest.approx(sum(scores[a : b + 1]))


def test_prior_of_a_stem_reaches_unseen_forms():
    counts = {"vil": (60, 60), "vile": (50, 0), "vilex\0": (5, 0), "vill": (0, 60)}
    weights = t.Weights.fit(counts, 1000, 10_000)
    assert weights.of["vileness"] == weights.of["viles"] > weights.of["vilify"] == weights.of["vile"] > 0
    assert weights.of["village"] < weights.of["vilify"] and weights.of["other"] == 0


def test_weights_of_long_stems_with_many_toxic_tokens_are_finite():
    word = "disgustingly"
    counts = {stem: np.array([20_000.0, 0.0]) for stem in t.prefixes(word)}
    weights = [t.Weights.fit(counts, 1e6, 1e7).stems[stem] for stem in t.prefixes(word)]
    assert np.isfinite(weights).all() and (np.diff(weights) > 0).all()
    phrase = {tuple("abc"): np.array([[0.0, 9.0], [0.0, 9.0]])}
    sure = t.Weights({})
    sure.of["b"] = 400.0
    assert t.phrase_weights(phrase, (0, 1), 0.1, sure) == {tuple("abc"): t.PHRASE_MOST}


def make(spark, n=400, seed=0):
    draw = random.Random(seed)
    words = [a + b for a, b in combinations("ba de lo mi ta ro su ne ki po".split(), 2)]
    bad = ["zork" + x for x in ("", "s", "ed", "ing", "er", "ly")]
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.choice((5, 40, 300)))]
        toxic = i % 5 == 0
        for _ in range(draw.randint(2, 4) if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_unseen_documents_and_passages(spark):
    docs, labels = make(spark)
    model = t.fit(docs, labels.where("doc_id % 3 <> 1"))
    rows = t.score(docs.where("doc_id % 3 = 1"), model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    right = sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    for row in rows:
        assert 0 <= row.score <= 1
        for span in row.passages:
            assert "zork" in texts[row.doc_id][span.start : span.end] or row.score < 0.7


def test_words_of_a_repeated_passage_keep_a_weight(spark):
    """Inner words of a passage that all toxic documents repeat have one context, yet many texts hold them."""
    docs, labels = make(spark)
    passage = "vorn hesk quib drell mawp"
    clean = docs.where("doc_id % 5 <> 0").collect()
    rows = [(r.doc_id, r.text, "x") for r in clean] + [(5 * i, f"{clean[i].text} {passage} {clean[-i - 1].text}", "x") for i in range(80)]
    model = t.fit(spark.createDataFrame(rows, "doc_id long, text string, score string"), labels)
    weights = t.Weights(model.stems)
    assert min(weights.of[word] for word in passage.split()) > 0
    assert model.scorer()("bade hesk quib drell lomi")[0] >= 0.7 > model.scorer()("bade lomi tane")[0]


def test_edge_rows(spark):
    docs, labels = make(spark)
    model = t.fit(docs, labels)
    rows = [(1, None), (2, ""), (3, "?!"), (3, "?!"), (None, "zorked " * 30_000), (4, "İZORKS zorking zorker")]
    out = t.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len({r.score for r in out[:4]}) == 1 and out[0].score < 0.7 and out[0].passages == []
    assert out[4].score > 0.7 and out[5].score > 0.7 and out[4].doc_id is None


@pytest.mark.parametrize("kept, score", [("false", 0.0), ("label = 1", 1.0), ("label = 0", 0.0)])
def test_without_both_labels(spark, kept, score):
    docs, labels = make(spark, 20)
    out = t.score(docs, t.fit(docs, labels.where(kept))).collect()
    assert {round(r.score, 6) for r in out} == {score}


def test_empty_documents(spark):
    docs, labels = make(spark, 20)
    assert t.score(docs.limit(0), t.fit(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded_and_balanced(spark):
    _, labels = make(spark)
    rows = t.labelled_sample(labels, 30).collect()
    assert sorted(r.label for r in rows) == [0] * 30 + [1] * 30


def test_query_on_held_out_rows(spark):
    from corpuslens.llm.queries import op2_toxicity

    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = op2_toxicity(spark, path).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize(
    "text, words",
    [
        ("an id!ot, IDI0T! and B2B", ["an", "idiot", "idiot", "and", "b2b"]),
        ("1d10t 1984 a1", ["idiot", "1984", "ai"]),
        ("i.d.i.o.t or i d-i o t; a b", ["idiot", "or", "idiot", "a", "b"]),
        ("Ídïöt $tupid wow!! 50€ 5$ | x", ["idiot", "stupid", "wow", "50", "5", "x"]),
        ("", []),
    ],
)
def test_words_lose_their_disguise(text, words):
    assert [t.plain_word(w) for w in t.words_of(text)[1]] == words


def _disguises():
    yield "digits", lambda w: w.replace("o", "0").replace("s", "5")
    yield "dots", lambda w: ".".join(w)
    yield "marks", lambda w: w.replace("o", "\u00f6")
    yield "prefix", lambda w: "ultra" + w


@pytest.mark.parametrize("name, change", list(_disguises()))
def test_disguised_words_are_caught(spark, name, change):
    docs, labels = make(spark)
    model = t.fit(docs, labels)
    of = model.scorer()
    clean = " ".join(["bade lomi tane sune", "kipo baro mine tasu"] * 20)
    assert of(f"{clean} {change('zorks')} {change('zorker')} {change('zorks')} {clean}")[0] >= 0.7 > of(clean)[0]


def test_a_passage_of_usual_words_is_caught(spark):
    """Each word is as common in clean texts; only their order is toxic. A rare kind among many other labels."""
    docs, labels = make(spark, 900, 3)
    passage = "tane bade suki lomi neki bami tasu dero baki lopo"
    rows = [tuple(r) for r in docs.collect()]
    usual = [w for r in rows for w in r[1].split()[:3] if not w.startswith("zork")]
    draw = random.Random(5)
    body = lambda n: " ".join(draw.choices(usual + passage.split(), k=n))
    rows += [(10_000 + i, f"{body(40)} {passage} {body(60)}" if i % 2 else body(110), "x") for i in range(120)]
    kinds = [tuple(r) for r in labels.collect()] + [(10_000 + i, i % 2) for i in range(80)]
    model = t.fit(spark.createDataFrame(rows, docs.schema), spark.createDataFrame(kinds, labels.schema))
    scores = {r.doc_id: r.score for r in t.score(spark.createDataFrame(rows, docs.schema), model).collect()}
    unseen = [scores[10_000 + i] >= 0.7 for i in range(80, 120) if i % 2]
    assert np.mean(unseen) >= 0.9
    assert np.mean([scores[10_000 + i] < 0.7 for i in range(80, 120, 2)]) >= 0.95


def test_passages_that_many_texts_share_are_not_toxic(spark):
    """A passage that toxic and clean documents repeat alike says nothing."""
    docs, labels = make(spark, 600, 4)
    passage = " ".join(["tane bade suki lomi neki bami tasu dero baki lopo"] * 6)
    rows = [(r.doc_id, f"{r.text} {passage}" if r.doc_id % 3 == 0 else r.text, "x") for r in docs.collect()]
    model = t.fit(spark.createDataFrame(rows, docs.schema), labels)
    assert model.scorer()(passage)[0] < 0.7

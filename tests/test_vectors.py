import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import with_tokens
from corpuslens.functions.vectors import cosine_distance, cosine_similarity, expand
from corpuslens.operators import embeddings as em


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("a", 1, 0, [1.0, 0.0]), ("a", 2, 1, [0.0, 2.0]), ("a", 3, 0, [1.0, 2.0]), ("b", 4, 1, [0.0, 0.0])],
        "dataset string, id int, label int, embedding array<float>",
    )


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], None)], "a array<double>, b array<double>"
    )
    got = df.select(cosine_similarity(F.col("a"), F.col("b")), cosine_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(2**-0.5) and got[0][1] == pytest.approx(1 - 2**-0.5)
    assert tuple(got[1]) == (0.0, 1.0)
    assert tuple(got[2]) == (None, None)


def test_centroids(rows):
    got = {r["dataset"]: r["centroid"] for r in em.centroids(rows, ["dataset"]).collect()}
    assert got["a"] == pytest.approx([2 / 3, 4 / 3]) and got["b"] == [0.0, 0.0]


def test_similarity_to_centroid(rows):
    center = em.centroids(rows.filter("label = 1"), [])
    got = {r["id"]: r["s"] for r in em.similarity_to(rows, center, "s").collect()}
    assert got == {1: 0.0, 2: pytest.approx(1.0), 3: pytest.approx(2 / 5**0.5), 4: 0.0}


def test_distance_to_neutral(rows):
    neutral = em.neutral_centroids(rows)
    got = {r["id"]: r["embedding_distance_to_neutral"] for r in em.distance_to_neutral(rows, neutral).collect()}
    assert got[1] == pytest.approx(1 - 2**-0.5)
    assert got[4] is None  # no neutral row in its dataset


def test_expand(rows):
    assert expand(rows, "embedding", 2).select("embed_0", "embed_1").filter("id = 3").first() == (1.0, 2.0)


def test_attach(spark, rows):
    base = spark.createDataFrame([(1,), (99,)], "id int")
    got = {r["id"]: r["embedding"] for r in em.attach_embeddings(base, rows, ["id"], 2).collect()}
    assert got == {1: [1.0, 0.0], 99: [0.0, 0.0]}


def test_user_encoder_in_batches(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    df = spark.createDataFrame([(i, "a" * i) for i in range(10)], "id int, clean string")
    got = {r["id"]: r["embedding"] for r in em.encode_with(df, make, batch_size=3).collect()}
    assert got == {i: [float(i), float(i)] for i in range(10)}


def test_word2vec(spark):
    df = with_tokens(spark.createDataFrame([(i, "red cat sat on red mat") for i in range(20)], "id int, text string"))
    got = em.encode_word2vec(df, size=4, minCount=1, numPartitions=2).collect()
    assert len(got) == 20 and all(len(r["embedding"]) == 4 for r in got)

from dataclasses import replace

import pytest

from catalog import inputs as src
from corpuslens.plans.features import row_features
from corpuslens.streaming.rows import read_posts, write_row_features


def test_stream_equals_batch(spark, sf_small, tmp_path):
    posts = src.posts(spark, sf_small)
    source = str(tmp_path / "in")
    posts.write.parquet(source)
    words = src.dictionaries(spark)
    query = write_row_features(
        read_posts(spark, source, posts.schema), words,
        str(tmp_path / "out"), str(tmp_path / "checkpoint"),
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = row_features(posts, words).drop("clean", "tokens")
    assert streamed.count() == posts.count()
    assert streamed.select(*batch.columns).exceptAll(batch).isEmpty()


def test_large_dictionary_is_refused_before_the_start(spark, sf_small, tmp_path):
    posts = src.posts(spark, sf_small)
    source = str(tmp_path / "in")
    posts.write.parquet(source)
    many = spark.range(5000).selectExpr("concat('w', id) AS word", "id / 10000 AS polarity", "0.5D AS subjectivity")
    words = replace(src.dictionaries(spark), polarity=many)
    with pytest.raises(ValueError, match="stream"):
        write_row_features(read_posts(spark, source, posts.schema), words, str(tmp_path / "out"), str(tmp_path / "c"))

import hashlib

from corpuslens.llm import exact
from corpuslens.llm.groups import attach

SCHEMA = "doc_id long, text string, digest string"
ROWS = [(1, "Ab c"), (2, "aB C"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "solo"), (None, "solo"), (8, "x"), (8, "x"), (None, "only"), (None, "only")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], SCHEMA)


def test_decisions(spark):
    out = exact.DigestIndex(spark).add(frame(spark, ROWS)).collect()
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str)
    assert found == sorted(
        [
            *((1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True)),
            *((7, 7, 2, True), (None, 7, 2, False), (8, 8, 2, True), (8, 8, 2, False), (None, None, 2, True), (None, None, 2, False)),
        ],
        key=str,
    )
    digest = next(bytes(r.digest) for r in out if r.doc_id == 1)
    assert digest == hashlib.sha256(b"ab c").digest()


def test_later_batches_meet_the_index(spark):
    index = exact.DigestIndex(spark)
    index.add(frame(spark, [(1, "a"), (2, "b")]))
    out = {r.doc_id: (r.keep_id, r.kept) for r in index.add(frame(spark, [(10, "A"), (11, "c"), (12, "c")])).collect()}
    assert out == {10: (1, False), 11: (12, False), 12: (12, True)}
    assert index.rows().count() == 3
    # The same batch again adds nothing.
    assert not any(r.kept for r in index.add(frame(spark, [(10, "A"), (11, "c"), (12, "c")])).collect())
    assert index.rows().count() == 3


def test_an_index_is_opened_again(spark, tmp_path):
    place = f"file:{tmp_path}/index"
    exact.DigestIndex(spark, place, 3).add(frame(spark, [(1, "a"), (2, "b")]))
    later = exact.DigestIndex(spark, place, 3)
    out = {r.doc_id: r.keep_id for r in later.add(frame(spark, [(5, "B"), (6, "c")])).collect()}
    assert out == {5: 2, 6: 6} and exact.DigestIndex(spark, place, 3).rows().count() == 3


def test_index_is_not_shuffled(spark):
    index = exact.DigestIndex(spark)
    index.add(frame(spark, [(i, str(i)) for i in range(50)]))
    new = spark.createDataFrame([(b"x",)], "digest binary").groupBy("digest").count()
    plan = new.join(index.rows().hint("merge"), "digest", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_a_hot_group(spark):
    rows = [(i, "same") for i in range(3000)] + [(i, f"t{i % 1500}") for i in range(3000, 6000)]
    out = exact.DigestIndex(spark).add(frame(spark, rows)).collect()
    assert len(out) == 6000 and sum(r.kept for r in out) == 1501
    assert {r.keep_id for r in out if r.doc_id < 3000} == {2999}
    assert {r.group_size for r in out if r.doc_id >= 3000} == {2}


def test_attach_keeps_rows_without_a_key_or_group(spark):
    rows = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, None), (4, b"a")], "id long, k binary")
    groups = spark.createDataFrame([(b"a", 2, 10)], "k binary, n long, v long")
    out = {r.id: r.v for r in attach(rows, groups, "k", "n", ["v"]).collect()}
    assert out == {1: 10, 2: None, 3: None, 4: 10}


def test_kept_rows_have_all_columns(spark):
    out = exact.keep_first(frame(spark, ROWS), exact.DigestIndex(spark))
    assert out.columns == ["doc_id", "text", "digest"]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "only"), (2, "aB C"), (3, "É"), (4, "é"), (6, ""), (7, "solo"), (8, "x")]


def test_empty_table(spark):
    index = exact.DigestIndex(spark)
    assert index.add(frame(spark, [])).count() == 0
    assert exact.keep_first(frame(spark, []), index).count() == 0

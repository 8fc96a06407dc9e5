import json

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import readers as rd
from corpuslens.sources import writers as wr


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_scan(spark, tmp_path):
    path = write(
        tmp_path / "posts.csv",
        'Comment,Hateful,other\n"two\nlines, ""quoted""",1,x\nNA,0,y\n,False,z\nplain,neutral,z\n',
    )
    rows = rd.load_dataset(spark, path, "Comment", "Hateful", dataset="reddit")
    got = sorted((r["text"], r["label"]) for r in rows.collect())
    assert got == [("", 0), ("", 0), ("plain", 0), ('two\nlines, "quoted"', 1)]
    assert rows.columns == ["dataset", "id", "text", "label"]
    ids = [r["id"] for r in rows.collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(r["id"] for r in rows.collect())


def test_labels_are_mapped_or_refused(spark):
    raw = spark.createDataFrame(
        [(1, "a", "Hateful"), (2, "b", "normal"), (3, "c", None), (4, "d", "hateful"), (5, "e", "")],
        "id long, text string, label string",
    )
    rows = rd.posts_from(raw, id_column="id", positive=["hateful"], neutral=["normal"])
    assert {r["id"]: r["label"] for r in rows.collect()} == {1: 1, 2: 0, 3: None, 4: 1, 5: None}
    profile = rd.dataset_profile(rows).first()
    assert (profile["n_rows"], profile["n_unlabelled"], profile["n_positive"]) == (5, 2, 2)
    with pytest.raises(ValueError, match=r"'Hateful' \(1 rows\)"):
        rd.posts_from(raw, id_column="id")


def test_tsv_scan(spark, tmp_path):
    path = write(tmp_path / "posts.tsv", "id\ttext\tlabel\n7\ta,b\t1.0\n")
    rows = rd.load_dataset(spark, path, id_column="id").collect()
    assert [(r["id"], r["text"], r["label"]) for r in rows] == [(7, "a,b", 1)]


def test_scan_guards(spark, tmp_path):
    path = write(tmp_path / "posts.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="missing required columns: label, text"):
        rd.load_dataset(spark, path)
    with pytest.raises(ValueError, match="xlsx"):
        rd.load_dataset(spark, str(tmp_path / "posts.xlsx"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.load_dataset(spark, str(tmp_path / "absent.csv"))


def test_columns_are_pruned(spark, sf_small):
    rows = rd.load_dataset(
        spark, f"{sf_small}/labels.parquet", text_column="quality", label_column="toxic", id_column="doc_id"
    )
    plan = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_named_datasets(spark, tmp_path):
    paths = {
        name: write(tmp_path / f"{name}.csv", f"id,text,label\n1,{name} post,{i % 2}\n")
        for i, name in enumerate(("reddit", "4chan", "twitter"))
    }
    rows = rd.load_datasets(spark, paths, id_column="id")
    assert {r["dataset"]: r["label"] for r in rows.collect()} == {
        "reddit": 0, "4chan": 1, "twitter": 0,
    }
    profile = {r["dataset"]: r for r in rd.dataset_profile(rows).collect()}
    assert (profile["4chan"]["n_rows"], profile["4chan"]["positive_ratio"]) == (1, 1.0)


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, x double")
    b = spark.createDataFrame([(2, 3)], "id int, y int")
    got = sorted(tuple(r) for r in rd.union_named([a, b]).collect())
    assert got == [(1, 2.0, 0), (2, 0.0, 3)]


def test_lexicon_scan_and_sink(spark, tmp_path):
    path = write(tmp_path / "terms.txt", "  Zeta \n\nalpha\n\talpha beta\t\nALPHA\n")
    terms = rd.load_lexicon(spark, path)
    assert sorted(r["term"] for r in terms.collect()) == ["alpha", "alpha", "alpha beta", "zeta"]
    out = str(tmp_path / "out")
    wr.save_lexicon(terms, out)
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().split("\n") if line]
    assert lines == ["alpha", "alpha beta", "zeta"]


def test_json_and_csv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p0", 1, 0.5), ("p0", 2, 0.7)], "dataset string, fold int, f1 double")
    nested = rows.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("fold", "f1"))).alias("fold_metrics")
    )
    wr.save_json(nested, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {
        "dataset": "p0", "fold_metrics": [{"fold": 1, "f1": 0.5}, {"fold": 2, "f1": 0.7}],
    }
    wr.save_csv(rows, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True)
    assert sorted(tuple(r) for r in back.collect()) == [("p0", 1, 0.5), ("p0", 2, 0.7)]


def test_run_tree(spark, tmp_path):
    rows = spark.createDataFrame([("cv", 0.5), ("loo", 0.7)], "regime string, f1 double")
    base = str(tmp_path / "runs")
    run = wr.save_run(rows, base)
    assert run[8] == "_" and run[15] == "_"
    back = wr.read_runs(spark, base, rows.schema).filter((F.col("run_id") == run) & (F.col("regime") == "cv"))
    assert [r["f1"] for r in back.collect()] == [0.5]
    assert (tmp_path / "runs" / f"run_id={run}" / "regime=loo").is_dir()


def test_runs_of_one_second_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("cv", 0.5)], "regime string, f1 double")
    base = str(tmp_path / "runs")
    runs = [wr.save_run(rows, base) for _ in range(2)]
    assert len(set(runs)) == 2
    assert sorted(r["run_id"] for r in wr.read_runs(spark, base, rows.schema).collect()) == sorted(runs)
    assert [r["run_id"] for r in wr.read_runs(spark, base, rows.schema, runs[:1]).collect()] == runs[:1]
    with pytest.raises(Exception, match="(?i)exist"):
        wr.save_run(rows, base, runs[0])


def test_a_failed_run_is_invisible(spark, tmp_path):
    rows = spark.createDataFrame([("cv", 0.5), ("loo", 0.0)], "regime string, f1 double")
    base = str(tmp_path / "runs")
    whole = wr.save_run(rows, base)
    failing = rows.withColumn("f1", F.when(F.col("regime") == "cv", F.col("f1")).otherwise(F.raise_error(F.lit("task fails")).cast("double")))
    with pytest.raises(Exception, match="task fails"):
        wr.save_run(failing, base, "half")
    # Files of a run that was stopped before its manifest.
    rows.write.partitionBy("regime").mode("overwrite").parquet(f"{base}/run_id=half")
    assert {r["run_id"] for r in wr.read_runs(spark, base, rows.schema).collect()} == {whole}


def test_spread_only_where_splits_are_few(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(100).coalesce(1)
    assert rd.spread(few, "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 1)
    assert rd.spread(many, "id") is many

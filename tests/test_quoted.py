"""Quoted CSV in many byte ranges against the scan by one task per file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import quoted
from corpuslens.sources import readers as rd

CELLS = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "\n", '"', '""', "", "é\n\n\nö", ' "a",\n"b" ', "x" * 90, "\n".join("long" * 9) * 3]


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def save(path, seed, end="\n", rows=120):
    draw = random.Random(seed)
    with path.open("w", newline="", encoding="utf-8") as out:
        table = csv.writer(out, lineterminator=end)
        table.writerow(["id", "text", "odd `name`"])
        table.writerows([i, draw.choice(CELLS), draw.choice(CELLS)] for i in range(rows))
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def whole(spark, path, sep=","):
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path, sep=sep)


@pytest.mark.parametrize("size", [40, 150, 1000, 1_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_scan_by_one_task(spark, tmp_path, small_ranges, size, end):
    path = save(tmp_path / "posts.csv", size, end)
    expected = rows_of(whole(spark, path))
    small_ranges(size)
    got = quoted.read_quoted(spark, path)
    assert got.columns == ["id", "text", "odd `name`"]
    assert rows_of(got) == expected and len(expected) == 120


def test_many_tasks_read_one_file(spark, tmp_path, small_ranges):
    path = save(tmp_path / "posts.csv", 1)
    small_ranges(500)
    parts = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start")).distinct().count()
    assert parts > 8 and quoted.read_quoted(spark, path).rdd.getNumPartitions() > 8


def test_more_open_ranges_than_are_listed(spark, tmp_path, small_ranges):
    path = save(tmp_path / "posts.csv", 2)
    expected = rows_of(whole(spark, path))
    small_ranges(100)
    assert rows_of(quoted.read_quoted(spark, path, max_listed=0)) == expected


def test_folder_and_blank_lines(spark, tmp_path, small_ranges):
    folder = tmp_path / "posts.csv"
    folder.mkdir()
    for i in range(3):
        save(folder / f"{i}.csv", i, rows=20)
    (folder / "3.csv").write_text('\nid,text,odd `name`\n\n7,"a\n\nb",\n\n', encoding="utf-8")
    (folder / "4.csv").write_text("id,text,odd `name`\n", encoding="utf-8")
    expected = rows_of(whole(spark, str(folder)))
    small_ranges(64)
    got = rows_of(quoted.read_quoted(spark, str(folder)))
    assert got == expected and len(got) == 61 and ("7", "a\n\nb", None) in got


def test_an_open_quote_is_refused(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('id,text\n1,"never closed\n2,b\n', encoding="utf-8")
    with pytest.raises(ValueError, match="odd number of quotes"):
        quoted.read_quoted(spark, str(path))


def test_load_dataset_split(spark, tmp_path, small_ranges):
    path = tmp_path / "posts.tsv"
    path.write_text('id\ttext\tlabel\n1\t"a\nb"\t1\n2\tNA\t0\n', encoding="utf-8")
    small_ranges(16)
    rows = rd.load_dataset(spark, str(path), id_column="id", multi_line="split")
    assert sorted((r["id"], r["text"], r["label"]) for r in rows.collect()) == [(1, "a\nb", 1), (2, "", 0)]

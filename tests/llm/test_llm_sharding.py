from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import sharding


def brute_table(names, slots):
    """Turn by turn, each shard walks its whole list of slots to the first that is free."""
    order = {}
    for name in names:
        offset, skip = sharding._hash(f"{name}|offset") % slots, sharding._hash(f"{name}|skip") % (slots - 1) + 1
        order[name] = [(offset + j * skip) % slots for j in range(slots)]
    owner = {}
    while len(owner) < slots:
        for k, name in enumerate(names):
            if len(owner) < slots:
                owner[next(s for s in order[name] if s not in owner)] = k
    return [owner[s] for s in range(slots)]


def test_table_equals_the_definition():
    names = [f"s{i}" for i in range(5)]
    assert sharding.lookup_table(names, 101).tolist() == brute_table(names, 101)


def test_even_and_steady():
    names = [f"s{i}" for i in range(16)]
    whole = sharding.lookup_table(names)
    counts = np.bincount(whole)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = (whole != fewer) & (whole != 15)
    assert moved.mean() < 0.1


def test_wrong_sizes():
    for names, slots in (([], 7), (["a"], 8), (["a", "b", "c"], 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_rows(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, "d")]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    out = sharding.assign(df, "doc_id", ["x", "y"])
    found = out.collect()
    assert out.columns == ["doc_id", "slot", "shard"] and len(found) == 4
    assert len({(r.slot, r.shard) for r in found if r.doc_id == 1}) == 1
    assert sharding.assign(df.limit(0), "doc_id", ["x"]).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    sharding.write_sharded(df, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 300
    placed = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", ["a", "b", "c"]).collect()}
    assert all(r.shard == placed[r.doc_id] for r in back)
    assert all(70 < n < 130 for n in Counter(placed.values()).values())

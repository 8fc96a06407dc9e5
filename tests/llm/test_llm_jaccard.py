import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import jaccard
from corpuslens.llm.components import connected


def brute(rows, size, percent):
    """Set sizes and smallest reachable ids by comparing all texts that share a shingle."""
    sets = [(i, jaccard.shingles_of(t or "", size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return {(i, len(s), top(i)) for i, s in sets}


def corpus(seed, n=120):
    """Texts with copies of copies, edited a little more each time."""
    draw, found = random.Random(seed), []
    for i in range(n):
        if found and draw.random() < 0.6:
            words = draw.choice(found)[1].split()
            for _ in range(draw.randint(0, 3)):
                if words:
                    words[draw.randrange(len(words))] = f"e{draw.randrange(10_000)}"
            words += [f"t{draw.randrange(9)}"] * draw.randint(0, 1)
        else:
            words = [f"w{draw.randrange(400)}" for _ in range(draw.choice((0, 1, 2, 5, 9, 20, 60, 200)))]
        found.append((i, " ".join(words)))
    return found


def result(spark, rows, size, percent):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node long, digest string")
    return jaccard.Join(df, size, percent).groups().collect()


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60)])
def test_equals_brute_force(spark, size, percent):
    rows = corpus(size)
    assert {tuple(r) for r in result(spark, rows, size, percent)} == brute(rows, size, percent)


def test_budgets_of_one(spark, monkeypatch):
    """With only one-deletion segments the links are the same."""
    monkeypatch.setattr(jaccard, "allocate", lambda high, count, percent: (0, (jaccard.difference(2 * high, percent) + 2) // 2))
    rows = corpus(7, 80)
    assert {tuple(r) for r in result(spark, rows, 2, 70)} == brute(rows, 2, 70)


def test_hot_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "PER_COPY", 3)
    draw = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(draw.randint(1, 6)):
            words[draw.randrange(60)] = f"e{i}-{draw.random()}"
        rows.append((i, " ".join(words)))
    assert {tuple(r) for r in result(spark, rows, 2, 75)} == brute(rows, 2, 75)


def test_edge_rows(spark):
    rows = [(5, "A b"), (3, "a  B"), (4, None), (2, ""), (9, " \n"), (1, "a b c"), (None, "a b"), (7, "long " * 5000), (8, "Long " * 5000)]
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in result(spark, rows, 3, 90)}
    assert out == {(5, 1, 3), (3, 1, 3), (4, 0, 4), (2, 0, 2), (9, 0, 9), (1, 1, 1), (None, 1, None), (7, 1, 7), (8, 1, 7)}


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (1, "a b c d")]
    assert {(r.doc_id, r.component_id) for r in result(spark, rows, 2, 90)} == {(1, 1), (2, 1), (3, 1)}


def test_only_ascii_letters_are_lowered(spark):
    out = result(spark, [(1, "É a"), (2, "é a"), (3, "É A"), (4, "a b"), (5, "a b")], 1, 100)
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}


def test_empty_table(spark):
    assert result(spark, [], 3, 90) == []


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    draw = np.random.default_rng(5)
    for count in (1, 10**9):
        scheme = jaccard.bands(400, defaultdict(lambda: count), percent)
        lows = np.array([band.low for band in scheme])
        for _ in range(150):
            n = int(draw.integers(1, 300))
            a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            b = a[draw.permutation(len(a))[: len(a) - int(draw.integers(0, max(1, n // 5)))]]
            b = np.unique(np.r_[b, draw.integers(0, 2**63, int(draw.integers(0, max(1, n // 10)))).astype(np.uint64)])
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                assert set(jaccard.keys_of(a, scheme, lows, percent)) & set(jaccard.keys_of(b, scheme, lows, percent))


def test_budgets_follow_cost():
    assert jaccard.allocate(10, 10, 90)[1] == 0
    assert jaccard.allocate(10, 10**9, 90)[1] > 0


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(1)
    for size in (0, 3, 100, 300, 900):
        for more in (1, 1.2):
            a, b = (np.unique(draw.integers(0, 500, int(n)).astype(np.uint64) * 7919) for n in (size, size * more))
            words = min(len(jaccard.sketch(a)), len(jaccard.sketch(b)))
            a_marks, b_marks = (jaccard.folded(jaccard.sketch(x), words).view(np.uint64) for x in (a, b))
            assert np.bitwise_count(a_marks ^ b_marks).sum() <= len(np.setxor1d(a, b))


def test_runs_over_any_batches():
    draw = random.Random(4)
    for _ in range(100):
        rows = sorted((draw.randrange(6), draw.randrange(5)) for _ in range(draw.randrange(30)))
        cuts = sorted(draw.randrange(len(rows) + 1) for _ in range(draw.randrange(5)))
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], names=["key", "node"])
            for a, b in zip([0, *cuts], [*cuts, len(rows)])
        ]
        out = [tuple(r.values()) for batch in jaccard._runs(iter(batches)) for r in batch.to_pylist()]
        nodes = defaultdict(set)
        for key, node in rows:
            nodes[key].add(node)
        assert sorted(out) == sorted((k, n, min(s)) for k, s in nodes.items() if len(s) > 1 for n in s)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    draw = random.Random(0)
    draw.shuffle(edges)
    out = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in out} == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", 1), (2, "a b c d e f", 2), (1, "q r s", 3), (None, "a b c d e f", 4), (4, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id long")
    assert sorted(jaccard.keep_one(df).collect(), key=lambda r: r.row_id) == [r for r in df.orderBy("row_id").collect() if r.row_id != 1]


def test_a_group_without_a_hub_is_not_paired_with_itself(spark, monkeypatch):
    """Variants of a text that is missing: pairs looked at grow with the sets, and no link is lost."""
    draw, made, kept = random.Random(5), [], jaccard.written

    def written(df, name, *by):
        found = kept(df, name, *by)
        if name == "near":
            made.append(found.count())
        return found

    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(240):
        words = list(base)
        for place in draw.sample(range(100), 2):
            words[place] = f"e{draw.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "written", written)
    assert {tuple(r) for r in result(spark, rows, 1, 90)} == brute(rows, 1, 90)
    assert sum(made) < 8 * len(rows), made


def test_keys_with_the_same_sets_are_looked_at_once(spark, monkeypatch):
    """Two sets under many keys and parts of their own: one pair comes out of the comparison."""
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, text + " y")], "doc_id long, text string")
    join, written = jaccard.Join(df, 1, 90), jaccard.written
    sets = join._sets()
    shared = spark.createDataFrame([(k, n, 1) for k in range(40) for n in (1, 2)] + [(40, 2, 2), (40, 3, 2)], "key long, node long, first long")
    up = spark.createDataFrame([], "node long, root long")
    looked_at = []
    monkeypatch.setattr(jaccard, "written", lambda df, name: looked_at.append(kept := written(df, name)) or kept)
    pairs = join._across(shared, up, sets.drop("digest"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (2, 3)]
    assert looked_at[0].count() == 2
    assert join._across(shared, up, sets.drop("digest"), 0).count() == 2

import random

import pytest

from corpuslens.llm import decontaminate as d


def edits(item, window):
    """Fewest edits to any part of the window, and the first end, by the full table."""
    column, best = list(range(len(item) + 1)), None
    for end, char in enumerate(window, 1):
        new = [0]
        for i, own in enumerate(item, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (own != char)))
        column = new
        if best is None or column[-1] < best[0]:
            best = (column[-1], end)
    return best


def test_bit_parallel_distance_equals_the_table():
    draw = random.Random(0)
    for _ in range(1500):
        item = "".join(draw.choice("abc") for _ in range(draw.randint(1, 80)))
        window = "".join(draw.choice("abc") for _ in range(draw.randint(1, 90)))
        best = edits(item, window)
        assert d.best_match(item, window, len(item)) == best
        assert d.best_match(item, window, best[0] - 1) is None


def test_pieces_cover_the_item():
    item = "abcdefghij" * 13
    parts = d.cut(item)
    assert len(parts) == d.budget(item) + 1 and "".join(p for _, p in parts) == item
    assert all(item.startswith(p, o) for o, p in parts)


@pytest.fixture(scope="module")
def planted():
    """Documents with benchmark items after 0 to budget + 2 edits, and ones without."""
    draw = random.Random(1)
    items = [(k, " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(30))) for k in range(12)]
    docs = []
    for i in range(150):
        text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(0, 60)))
        if i % 2:
            item = list(draw.choice(items)[1])
            for _ in range(draw.randint(0, d.budget("".join(item)) + 2)):
                at = draw.randrange(len(item))
                item[at] = draw.choice(["", "x", item[at] + "y"])
            text += " " + "".join(item).upper().replace(" ", " \n ") + " tail"
        docs.append((i, text))
    return docs, items


def expected(docs, items):
    found = set()
    for i, text in docs:
        text = d.normal(text or "")
        for k, item in items:
            item = d.normal(item or "")
            best = edits(item, text) if item and text else None
            if best and best[0] <= d.budget(item):
                found.add((i, k, best[0]))
    return found


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long"),
    )


@pytest.mark.parametrize("block", [10**9, 400])
def test_equals_brute_force_in_any_blocks(spark, planted, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_CHARS", block)
    out = d.find(*frames(spark, *planted)).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in out} == expected(*planted)
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})


def test_clean_keeps_the_rest_with_all_columns(spark, planted):
    docs, items = frames(spark, *planted)
    out = d.clean(docs, items)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _ in planted[0]} - {i for i, *_ in expected(*planted)}


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "abc def"), (4, "abc def"), (None, "ABC\tdef"), (5, "ab"), (6, "xyz " * 30_000 + "abc def")]
    items = [(1, "abc def"), (2, None), (3, ""), (4, "Abc  Def"), (5, " ")]
    out = d.find(*frames(spark, docs, items)).collect()
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in out) == sorted(
        (str(i), k, 0) for i in (4, 4, None, 6) for k in (1, 4)
    )


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    assert d.find(docs.limit(0), items).count() == 0
    assert d.find(docs, items.limit(0)).count() == 0
    assert d.clean(docs, items.limit(0)).count() == 1


def test_spans(spark):
    row = d.find(*frames(spark, [(1, "so  The Cat sat\ndown")], [(7, "the cat sat")])).first()
    assert d.normal("so  The Cat sat\ndown")[row.start : row.end] == "the cat sat"

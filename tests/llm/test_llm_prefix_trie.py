import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs long"


def brute(rows, rebuild=True):
    """The definition: all prefixes of all conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    lists = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        lists[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        found = [p]
        for q in found:
            found.extend(children[q])
        return found

    out = []
    for p, who in members.items():
        tree = below(p)
        out.append((
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), sum(not children[q] for q in tree),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in tree if q),
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, rebuild=True):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    c = F.col("conv_id")
    out = t.trie(frame, c - c % 5, F.crc32(c.cast("string")) % 9) if rebuild else t.trie(frame)
    return sorted((tuple(r) for r in out.collect()), key=str)


def conversations(seed, n=60):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(draw.choice((1, 2, 4, 12))):
            rows.append((c, k, draw.choice(("user", "assistant")), draw.choice(("a", "é", "", None, "long text"))))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_the_definition(spark, seed, rebuild):
    rows = conversations(seed)
    assert run(spark, rows, rebuild) == brute(rows, rebuild)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "b", "y"), (None, 0, "user", "lost"), (2, None, "", "x"), (7, 5, "user", "ü")]
    assert run(spark, rows, False) == brute(rows, False)
    assert run(spark, rows) == brute(rows)


def test_hot_conversation_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 7)
    rows = [(c, k, "user", f"same {k}") for c in range(300) for k in range(3)] + [(c, k, "user", f"same {k}" if k < 2 else f"own {c}") for c in range(300, 360) for k in range(4)]
    assert run(spark, rows, False) == brute(rows, False)


def test_long_conversation(spark):
    rows = [(c, k, "user", "again") for c, n in ((0, 3000), (1, 2990)) for k in range(n)]
    out = run(spark, rows, False)
    assert len(out) == 3001 and max(r[6] for r in out) == 2990 * 5


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 1, "user", "x")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_tree_is_balanced():
    lists = [([k], k, 1, "") for k in range(1023)]
    tree = t.Tree.balanced(lists)
    height = [0] * len(tree.key)
    for node in range(len(tree.key) - 1, -1, -1):
        height[node] = 1 + max((height[x] for x in (tree.low[node], tree.high[node]) if x != t.NONE), default=0)
    assert max(height) == 10

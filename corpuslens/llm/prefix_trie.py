"""Prefix trie of conversations, built in range shards and merged where shards meet.

Distinct turns get a number. A conversation is the list of its turns' numbers; equal lists are counted once, with the
number and a digest of the conversations that have them. The lists are dealt to shards by range, in order. Each shard
inserts its lists into a ternary search tree, the median first and then the medians of both halves, which keeps the trees
of siblings balanced, and walks it without recursion to add up members, leaves and savings. A prefix that several shards
share lies on the path of a shard's first or last list; only these nodes are merged afterwards, from the deepest up.

Defined results: a null role or text is empty; rows without a conversation id are left out; turns of one number are
ordered by role, then text; rows that repeat are turns of their own; of an empty table nothing is left, not even a root.
Only the four columns are read, so others cannot clash. One conversation is held by one task, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.groups import attach
from corpuslens.session import written

# Conversations of one list whose ids become one row before they are dealt out again.
CHUNK = 10_000
NONE = -1
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, sizes``: the numbers of a conversation's turns in order, and the UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text")
    )
    # The role's length keeps the two parts apart.
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    n_bytes = F.octet_length("text").cast("long")
    rows = written(plain.select("conv_id", place.alias("at"), digest.alias("digest"), n_bytes.alias("n_bytes")), "turns")
    groups = rows.groupBy("digest").agg(F.count("*").alias("size"))
    dictionary = written(groups.withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    known = attach(rows, dictionary, "digest", "size", ["turn_id"])
    cells = F.array_sort(F.collect_list(F.struct("at", "turn_id", "n_bytes")))
    lists = known.groupBy("conv_id").agg(cells.alias("cells"))
    return written(lists.select("conv_id", F.col("cells.turn_id").alias("turns"), F.col("cells.n_bytes").alias("sizes")), "conversations")


def with_heads(lists: DataFrame, head_of: Column, length: Column) -> DataFrame:
    """Every conversation's first ``length`` turns are replaced by those of the conversation ``head_of``, as far as it goes."""
    own = lists.withColumns({"_head": head_of, "_length": length.cast("int")})
    heads = lists.select(F.col("conv_id").alias("_head"), F.col("turns").alias("_turns"), F.col("sizes").alias("_sizes"))
    none = F.array().cast("array<bigint>")

    def joined(name: str) -> Column:
        first = F.slice(F.coalesce(f"_{name}", none), F.lit(1), F.col("_length"))
        return F.concat(first, F.slice(name, F.col("_length") + 1, F.size(name))).alias(name)

    return own.join(heads, "_head", "left").select("conv_id", joined("turns"), joined("sizes"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from zip(*(column.to_pylist() for column in batch.slice(start, 1024).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), schema), spark_schema)


CHUNKS = pa.schema([
    ("turns", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("first_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string()),
])
CHUNK_SCHEMA = "turns array<bigint>, sizes array<bigint>, first_id long, n long, ids string"


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Neighbouring rows ``turns, sizes, conv_id`` of one list as ``turns, sizes, first_id, n, ids``."""
    for (turns, sizes), members in groupby(rows, key=lambda r: r[:2]):
        held: list[int] = []
        for *_, conv_id in members:
            held.append(conv_id)
            if len(held) == CHUNK:
                yield turns, sizes, held[0], len(held), ",".join(map(str, held))
                held = []
        if held:
            yield turns, sizes, held[0], len(held), ",".join(map(str, held))


def _lists(chunks: Iterator[tuple]) -> Iterator[tuple]:
    """Chunks as one row ``turns, sizes, first_id, n, digest`` per list; the ids pass through the hash one chunk at a time."""
    for (turns, sizes), parts in groupby(chunks, key=lambda r: r[:2]):
        digest, first_id, total = hashlib.sha256(), None, 0
        for _, _, first, n, ids in parts:
            digest.update(f"{',' if total else ''}{ids}".encode())
            first_id, total = first if first_id is None else first_id, total + n
        yield turns, sizes, first_id, total, digest.hexdigest()


class Tree:
    """Ternary search tree over lists of numbers; node 0 is the root, and every other node stands for one prefix."""

    def __init__(self):
        self.key, self.low, self.high, self.inner = [NONE], [NONE], [NONE], [NONE]
        self.up, self.depth = [NONE], [0]
        self.n, self.first, self.digest = [0], [None], [None]

    def _child(self, node: int, key: int) -> int:
        """The child of ``node`` with ``key``, made if there is none."""
        at, slot, place = self.inner[node], self.inner, node
        while at != NONE and self.key[at] != key:
            slot, place = (self.low if key < self.key[at] else self.high), at
            at = slot[at]
        if at == NONE:
            at = slot[place] = len(self.key)
            for column, value in (
                (self.key, key), (self.low, NONE), (self.high, NONE), (self.inner, NONE), (self.up, node),
                (self.depth, self.depth[node] + 1), (self.n, 0), (self.first, None), (self.digest, None),
            ):
                column.append(value)
        return at

    def insert(self, keys: list[int], first: int, n: int, digest: str) -> None:
        node = 0
        for key in keys:
            node = self._child(node, key)
        self.n[node], self.first[node], self.digest[node] = n, first, digest

    def path(self, keys: list[int]) -> list[int]:
        nodes = [0]
        for key in keys:
            nodes.append(self._child(nodes[-1], key))
        return nodes

    @classmethod
    def balanced(cls, lists: list[tuple]) -> Tree:
        """From sorted ``(keys, first, n, digest)``: the median goes in first, then the medians of both halves."""
        tree, open_ranges = cls(), [(0, len(lists))]
        while open_ranges:
            low, high = open_ranges.pop()
            if low < high:
                middle = (low + high) // 2
                tree.insert(*lists[middle])
                open_ranges += [(middle + 1, high), (low, middle)]
        return tree


NODES = pa.schema([
    ("prefix", pa.binary()), ("parent_prefix", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ends_sha256", pa.string()),
])
NODE_SCHEMA = (
    "prefix binary, parent_prefix binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"
)


def _shard_nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """All nodes of a shard from its sorted ``turns, sizes, first_id, n, digest``.

    A node that other shards may have too carries its ``prefix`` digest, and its sums leave out itself and such nodes
    below it. A child of such a node carries ``parent_prefix``.
    """
    lists, sizes = [], {}
    for turns, n_bytes, first, n, digest in rows:
        lists.append((turns, first, n, digest))
        sizes.update(zip(turns, n_bytes))
    if not lists:
        return
    tree = Tree.balanced(lists)
    size = len(tree.key)
    # A node is made after its parent, so a walk against the order of making meets children first.
    n, first = list(tree.n), list(tree.first)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    shared: list[bytes | None] = [None] * size
    for turns in (lists[0][0], lists[-1][0]):
        prefix = hashlib.sha256()
        for node, key in zip(tree.path(turns), [None, *turns]):
            if key is not None:
                prefix.update(key.to_bytes(8, "little"))
            shared[node] = prefix.digest()
    for node in range(size - 1, -1, -1):
        up = tree.up[node]
        if shared[node] is None:
            if not children[node]:
                leaves[node] = 1
            saved[node] += (n[node] - 1) * sizes[tree.key[node]]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if up != NONE:
            n[up] += n[node]
            first[up] = first[node] if first[up] is None else min(first[up], first[node])
    for node in range(size):
        up = tree.up[node]
        above = None if up == NONE else shared[up]
        yield (
            shared[node], above, tree.depth[node], first[node], None if up == NONE or above else first[up], n[node],
            children[node], leaves[node], saved[node], sizes.get(tree.key[node], 0), tree.digest[node],
        )


def _merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Shared nodes, deepest first and equal ones side by side, to whole nodes with the sums of all below them."""
    waiting: dict[bytes, list[int]] = {}
    for prefix, parts in groupby(rows, key=lambda r: r[0]):
        parts = list(parts)
        _, above, depth, _, _, _, _, _, _, n_bytes, _ = parts[0]
        n, children, leaves, saved = (sum(p[i] for p in parts) for i in (5, 6, 7, 8))
        below = waiting.pop(prefix, [0, 0, 0])
        children, leaves, saved = children + below[0], leaves + below[1], saved + below[2]
        if not children:
            leaves = 1
        saved += (n - 1) * n_bytes
        if above is not None:
            sums = waiting.setdefault(above, [0, 0, 0])
            sums[0], sums[1], sums[2] = sums[0] + 1, sums[1] + leaves, sums[2] + saved
        ends = next((p[10] for p in parts if p[10] is not None), None)
        yield prefix, above, depth, min(p[3] for p in parts), None, n, children, leaves, saved, n_bytes, ends


def nodes(lists: DataFrame) -> DataFrame:
    """The trie of ``lists (conv_id, turns, sizes)``.

    One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. The last is the digest of the ids of those that end there.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A list that many have is cut by ids; its chunks are few.
    dealt = lists.select("turns", "sizes", "conv_id").repartitionByRange(n, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    chunks = written(_map(dealt, _chunks, CHUNKS, CHUNK_SCHEMA), "chunks")
    shards = chunks.repartitionByRange(n, "turns").sortWithinPartitions("turns", "first_id")
    found = written(_map(shards, lambda rows: _shard_nodes(_lists(rows)), NODES, NODE_SCHEMA), "nodes")
    # Two paths per shard, whatever the shards hold.
    shared = found.where("prefix IS NOT NULL").repartition(1).sortWithinPartitions(F.desc("depth"), "prefix")
    merged = written(_map(shared, _merged, NODES, NODE_SCHEMA), "merged")
    whole = merged.unionByName(found.where("prefix IS NULL"))
    above = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("_above"))
    return whole.join(above, "parent_prefix", "left").select(
        "conv_id", "depth", F.coalesce("_above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )


def trie(turns: DataFrame, head_of: Column | None = None, length: Column | None = None) -> DataFrame:
    """The trie of conversations ``turns (conv_id, turn, role, text)``, with replaced beginnings if these are given."""
    lists = numbered_turns(turns)
    return nodes(lists if head_of is None else with_heads(lists, head_of, length))

"""Set-similarity self-join of documents by word shingles: exact links, and the groups they connect.

Two sets link when ``100 * intersection >= percent * union``. Sizes are cut into bands so that linked sets lie in the same
or in neighbouring bands; the band of the larger set fixes the most elements in which the two may differ, H. A hash deals
the universe of shingles to segments. Each segment has a budget: 0 (a key is the subset of the set in it) or 1 (keys are
the subset and the subset with any one element left out), and the budgets plus one sum to H + 1 at least, so linked sets
share a key (pigeonhole). Budgets are set per band by cost: keys written against pairs that would meet by accident.

Keys are sorted, and those that only one set has are dropped. Then groups are joined in rounds, so that copies of copies
are not paired with each other: first every set is compared with the smallest id under its keys, and what links is one;
then with the closest set of another group under each key, while many link; at last all sets of different groups that
still share a key are compared. A parity sketch of each set bounds the
difference from below and rules out most pairs; the rest are verified on the words themselves. Equal sets count once.
Only a short fold of the sketch travels with a shared key; whole sketches are fetched once per pair.

Defined results: null or blank text has no shingle and links with nothing; a text with fewer words than a shingle has one,
its whole sequence; ties cannot occur, as links do not depend on order; rows that share an id are one document with several
texts; rows without an id link with nothing; an empty table gives an empty table. Only the id and text column are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Memo, id_and_text, map_texts
from corpuslens.llm.components import connected
from corpuslens.llm.groups import HOT_SHARE, attach, split_by
from corpuslens.session import written

# A sketch has at least so many bits, and at least two per element.
SKETCH_BITS = 512
# A fold has at least so many bits, and at least four per element in which linked sets may differ: sets that have nothing
# in common then differ in twice as many bits as linked ones may.
FOLD_BITS = 128
# Bits that tell which rows may be copies of others; 1 MB, good for some ten million copies.
COPY_BITS = 1 << 23
# Rows of one key that are compared in one piece; a key with more is cut into blocks, and pairs of blocks are spread.
BLOCK_ROWS = 256
# Most rounds in which a set meets only the closest of another group; the last round meets all that are left.
NEAREST_ROUNDS = 3
# Texts that are verified against one copy of another text.
PER_COPY = 256


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split()


def shingles_of(text: str, size: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Distinct 64-bit shingle hashes of a text, sorted."""

    def __init__(self, size: int):
        self.size = size
        self.word = Memo(xxhash.xxh64_intdigest)
        self.factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        width = min(self.size, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total += hashes[i : len(hashes) - width + 1 + i] * self.factors[i]
        return np.unique(mix(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of elements per bit; two sketches differ in at most as many bits as the sets in elements."""
    bits = max(SKETCH_BITS, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else SKETCH_BITS
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(marks: np.ndarray, size: int) -> np.ndarray:
    """A sketch as it would be with ``size`` words: halves are added."""
    while len(marks) > size:
        marks = marks[: len(marks) // 2] ^ marks[len(marks) // 2 :]
    return marks


@dataclass(frozen=True)
class Band:
    """Sizes ``low..high`` and the segments in which sets up to ``high`` are compared."""

    number: int
    low: int
    high: int
    plain: int  # segments with budget 0
    loose: int  # segments with budget 1

    @property
    def segments(self) -> int:
        return self.plain + self.loose


def difference(total: int, percent: int) -> int:
    """Most elements that only one of two linked sets has, for sets of ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def brief(marks: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The fold of the sketch of ``n`` elements that goes with its keys."""
    apart = difference(n + n * 100 // percent, percent)
    return folded(marks, max(FOLD_BITS, 1 << (4 * apart - 1).bit_length() if apart else 0) // 64)


def spare(need: int) -> int:
    """Plain segments beyond those needed, so that a set may leave out its emptiest."""
    return 1 + need // 8


def allocate(high: int, count: int, percent: int) -> tuple[int, int]:
    """Segments of budget 0 and 1 for sets of about ``high`` elements, ``count`` of them, at the least cost.

    Cost is the number of keys, plus the pairs that meet by accident: because each has more empty segments than it may
    leave out (budget 0), or one element at most in the same segment (budget 1).
    """
    need = difference(2 * high, percent) + 1
    steps = sorted({0, need // 4, need // 2, (need + 1) // 2})

    def cost(loose: int) -> float:
        plain = max(0, need - 2 * loose) if loose else need + spare(need)
        share = 1 / (plain + loose)
        none, one = (1 - share) ** high, high * share * (1 - share) ** (high - 1)
        if not loose:
            empty = plain * none
            # Poisson: chance of more empty segments than spare ones.
            few, term = 0.0, math.exp(-empty)
            for k in range(spare(need) + 1):
                few, term = few + term, term * empty / (k + 1)
            return count * need + (count * max(0.0, 1 - few)) ** 2 / 2
        return count * (plain + loose * (1 + high * share)) + count * count * (plain * none**2 + loose * (none + one) ** 2) / 2

    loose = min(steps, key=cost)
    return (max(0, need - 2 * loose), loose) if loose else (need + spare(need), 0)


def bands(largest: int, counts: dict[int, int], percent: int) -> list[Band]:
    """Bands up to one beyond the largest size; ``counts`` has the number of sets by size band."""
    found = []
    for number, (low, high) in enumerate(edges(largest, percent)):
        near = counts.get(number, 0) + counts.get(number - 1, 0)
        found.append(Band(number, low, high, *allocate(high, near, percent)))
    return found


def edges(largest: int, percent: int) -> list[tuple[int, int]]:
    found, low = [], 1
    while not found or found[-1][0] <= largest:
        high = max(low, low * 100 // percent)
        found.append((low, high))
        low = high + 1
    return found


def keys_in(hashes: np.ndarray, band: Band, need: int) -> np.ndarray:
    """Keys of a set in the segments of a band.

    Without segments of budget 1 there are more than ``need``, and the set gives only those of its fullest segments, ties
    by key. Linked sets have more equal segments than a set leaves out, and an equal segment ranks alike in both sets; so
    the first of the equal ones is given by both.
    """
    segment = ((hashes >> np.uint64(32)) % np.uint64(band.segments)).astype(np.int64)
    element = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    half, low_half = np.uint64(32), np.uint64(2**32 - 1)
    # Sums of 32-bit parts are exact; together they stand for the subset.
    high, low = (
        np.bincount(segment, part.astype(float), band.segments).astype(np.uint64) for part in (element >> half, element & low_half)
    )

    def key(high, low, segment):
        place = segment.astype(np.uint64) + np.uint64(band.number << 40)
        return mix(mix(high + np.uint64(0x632BE59BD9B4E019) * (place + np.uint64(1))) + low)

    keys = key(high, low, np.arange(band.segments))
    if not band.loose:
        sizes = np.bincount(segment, minlength=band.segments)
        return keys[np.lexsort((keys, -sizes))[:need]]
    loose = segment >= band.plain
    at, parts = segment[loose], element[loose]
    return np.unique(np.concatenate([keys, key(high[at] - (parts >> half), low[at] - (parts & low_half), at)]))


def keys_of(hashes: np.ndarray, scheme: list[Band], lows: np.ndarray, percent: int) -> np.ndarray:
    """Keys in the set's own band and in the next, where it meets larger sets."""
    at, found = int(np.searchsorted(lows, len(hashes), "right")) - 1, []
    for band in scheme[at : at + 2]:
        # The largest partner in the band fixes the most elements in which the two may differ.
        largest = min(band.high, len(hashes) * 100 // percent)
        if largest >= band.low:
            found.append(keys_in(hashes, band, difference(len(hashes) + largest, percent) + 1))
    return np.concatenate(found)


class Join:
    """Links between the texts of ``docs`` by shingles of ``size`` words at ``percent`` similarity."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < percent <= 100 or size < 1:
            raise ValueError("percent in 1..100 and a shingle of at least one word")
        self.texts = id_and_text(docs, id_col, text_col)
        self.size, self.percent = size, percent

    def groups(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` for every row; a component's id is its smallest document id."""
        sets = self._sets()
        classes = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        classes = classes.agg(F.min("doc_id").alias("node"), F.count("*").alias("members")).where("members > 1")
        classes = written(classes, "classes")
        plain = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        copies = attach(plain, classes, "digest", "members", ["node"]).where("node <> doc_id")
        copies = written(copies.select("doc_id", "digest", "node"), "copies")
        # Several texts of one document belong together.
        several = copies.join(sets.select("doc_id", F.col("digest").alias("more")), "doc_id").where("digest <> more")
        several = several.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
        hot = classes.where(F.col("members") > max(1, HOT_SHARE * self._rows(classes))).select("digest", "node")
        roots = self._roots(sets, copies.drop("node"), hot, several)
        classes = classes.join(roots, "node", "left").select("digest", "members", F.coalesce("root", "node").alias("class_root"))
        rows = attach(plain, written(classes, "class-roots"), "digest", "members", ["class_root"])
        rows = rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        found = F.least(F.coalesce("class_root", "doc_id"), F.coalesce("root", "doc_id"))
        return rows.select("doc_id", "n_shingles", found.alias("component_id"))

    @staticmethod
    def _rows(classes: DataFrame) -> int:
        return classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]

    def _sets(self) -> DataFrame:
        """``doc_id, n_shingles, digest, sketch, brief`` for every row."""
        size, percent = self.size, self.percent

        def start():
            hasher = Hasher(size)

            def work(ids, texts):
                sets = [hasher(text) for text in texts]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                marks = [sketch(s) for s in sets]
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(marks, pa.list_(pa.int64())),
                    pa.array([brief(m, len(s), percent) for m, s in zip(marks, sets)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sketch", "brief"])

            return work

        schema = "doc_id long, n_shingles long, digest binary, sketch array<long>, brief array<long>"
        return written(map_texts(self.texts, start, schema), "sets")

    def _scheme(self, sets: DataFrame) -> list[Band]:
        largest = sets.agg(F.coalesce(F.max("n_shingles"), F.lit(0))).first()[0]
        lows = [low for low, _ in edges(largest, self.percent)]
        band = F.expr("size(filter(array({}), x -> x <= n_shingles)) - 1".format(",".join(f"{low}L" for low in lows)))
        # One row per band, and their number is the logarithm of the largest size.
        counts = {row.band: row["count"] for row in sets.where("n_shingles > 0").groupBy(band.alias("band")).count().collect()}
        return bands(largest, counts, self.percent)

    def _shared(self, sets: DataFrame, copies: DataFrame, hot: DataFrame) -> DataFrame:
        """``key, node, first``: sets under keys that several sets have, and the smallest id under the key.

        Copies give no keys. Those in ``hot`` classes, fewer than 1 / HOT_SHARE, are known by broadcast; of the other rows
        only those that a bitmap takes for copies are shuffled to find out.
        """
        size, percent, scheme = self.size, self.percent, self._scheme(sets)
        lows = np.array([band.low for band in scheme])

        def start():
            hasher = Hasher(size)

            def work(ids, texts):
                rows = [(i, s) for i, s in zip(ids, map(hasher, texts)) if len(s) and i is not None]
                columns = [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for _, s in rows], pa.binary()),
                    pa.array([keys_of(s, scheme, lows, percent).view(np.int64) for _, s in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "keys"])

            return work

        cold = written(copies.join(F.broadcast(hot), "digest", "left_anti"), "cold-copies")
        parts = split_by(self.texts, cold.select("doc_id"), {"doc_id": F.col("doc_id")}, COPY_BITS)
        doubtful, sure = (map_texts(texts, start, "doc_id long, digest binary, keys array<long>") for texts in parts)
        rows = sure.unionByName(doubtful.join(cold, ["doc_id", "digest"], "left_anti"))
        rows = rows.join(F.broadcast(hot), "digest", "left").where("node IS NULL OR node = doc_id")
        rows = rows.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
        rows = rows.repartition("key").sortWithinPartitions("key", "node")
        return written(rows.mapInArrow(_runs, "key long, node long, first long"), "shared")

    def _roots(self, sets: DataFrame, copies: DataFrame, hot: DataFrame, several: DataFrame) -> DataFrame:
        """``node, root`` of every node that links."""
        shared = self._shared(sets, copies, hot)
        nodes = written(shared.select("node").distinct(), "nodes")
        marks = written(sets.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "n_shingles", "sketch", "brief"), "marks")
        # First round: at most one pair per set, with the most similar of the smallest ids under its keys.
        pairs = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        pairs = self._plausible(pairs, marks).groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
        tree = written(self._verified(pairs), "tree")
        up = tree.select(F.col("b").alias("node"), F.col("a").alias("root"))
        # A parent has a smaller id, so two steps up shorten the tree; any part of a group is enough here.
        for _ in range(2):
            above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            up = up.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        up = written(up, "up")
        # Further rounds: every set under a key meets the closest one of another part, so there are no more pairs than rows.
        found, turn = tree.unionByName(several), 0
        while True:
            pairs = self._plausible(written(self._across(shared, up, marks, turn), "near"), marks)
            links = written(self._verified(pairs), "links")
            up = self._merged(up, links.unionByName(found))
            # The last round finds what these leave, so they end once they join few sets.
            turn += 1
            if turn == NEAREST_ROUNDS or links.count() * 100 <= nodes.count():
                break
            found = links.limit(0)
        # Last round: all sets of different parts under one key. Few of them link, as whole groups have become parts.
        pairs = self._plausible(written(self._across(shared, up, marks), "near"), marks)
        return self._merged(up, written(self._verified(pairs), "links"))

    @staticmethod
    def _merged(up: DataFrame, links: DataFrame) -> DataFrame:
        """``node, root`` once the parts that ``links (a, b)`` join are one."""
        ends = links
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(side), F.col("root").alias(f"up_{side}")), side, "left")
        ends = ends.select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b")).where("a <> b")
        top = connected(ends.distinct())
        above = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
        below = up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return written(top.unionByName(below).groupBy("node").agg(F.min("root").alias("root")), "roots")

    def _plausible(self, pairs: DataFrame, marks: DataFrame) -> DataFrame:
        """Pairs whose sizes allow a link and whose sketches do not rule it out, with ``apart`` sketch bits."""
        for side in ("a", "b"):
            own = marks.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
            pairs = pairs.join(own, side)
        p = self.percent
        pairs = pairs.where(f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b)").withColumn("words", F.expr("least(size(s_a), size(s_b))"))

        def fold(name):
            # Pieces of the length of the shorter sketch, added up.
            more = F.expr(f"filter(sequence(0, size({name}) DIV words - 1), x -> x > 0)")

            def add(total, at):
                return F.zip_with(total, F.slice(name, at * F.col("words") + 1, F.col("words")), lambda x, y: x.bitwiseXOR(y))

            return F.aggregate(more, F.slice(name, 1, F.col("words")), add)

        bits = F.zip_with(fold("s_a"), fold("s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        pairs = pairs.select("a", "b", "n_a", "n_b", F.aggregate(bits, F.lit(0), lambda total, x: total + x).alias("apart"))
        return pairs.where(f"apart <= (n_a + n_b) * {100 - p} DIV {100 + p}").select("a", "b", "apart")

    def _across(self, shared: DataFrame, up: DataFrame, marks: DataFrame, turn: int | None = None) -> DataFrame:
        """Pairs under one key that sizes and folds allow, whose ends are not yet in one part.

        With a ``turn`` only the closest of each set, within one block; every turn cuts other blocks. Of keys with the same
        sets (a digest of 128 bits tells) one is looked at, as copies share almost all of theirs.
        """
        rows = shared.join(up, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
        marked = rows.withColumns({"_x": F.xxhash64("node"), "_y": F.xxhash64(F.lit(1), "node")})
        keys = marked.groupBy("key").agg(
            F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.bit_xor("_x").alias("x"), F.bit_xor("_y").alias("y")
        )
        keys = keys.where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
        keys = written(keys.select("key", F.expr(f"int(ceil(n / {BLOCK_ROWS}))").alias("blocks")), "open-keys")
        rows = rows.join(keys, "key").join(marks, F.col("node") == F.col("doc_id"))
        own = F.expr(f"int(pmod(xxhash64(node, {turn or 0}), blocks))")
        others = F.expr("sequence(0, blocks - 1)") if turn is None else F.array(own)
        rows = rows.select("key", "node", "part", "n_shingles", "brief", own.alias("own"), F.explode(others).alias("other"))
        rows = rows.select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part", "n_shingles", "brief"
        )
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        percent, nearest = self.percent, turn is not None

        def compare(batches):
            for block in _blocks(batches):
                yield from _close_pairs(block, percent, nearest)

        return rows.mapInArrow(compare, "a long, b long").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their words. A text meets many others in several copies, spread over tasks."""
        size, percent = self.size, self.percent
        pairs = written(pairs.select("a", "b"), "pairs")
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        texts, _ = split_by(self.texts, ends, {"node": F.col("doc_id")})
        texts = written(texts.join(ends, F.col("doc_id") == F.col("node"), "left_semi"), "texts")
        many = pairs.groupBy("a").agg(F.expr(f"int(ceil(count(*) / {PER_COPY}))").alias("parts"))
        pairs = pairs.join(many, "a").select("a", F.expr("int(pmod(xxhash64(b), parts))").alias("part"), "b")
        heads = pairs.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        tails = pairs.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
        rows = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

        def compare(batches):
            group, sets = None, []
            for batch in batches:
                linked = []
                for a, part, b, text in zip(*(column.to_pylist() for column in batch.columns)):
                    if group != (a, part):
                        group, sets = (a, part), []
                    own = shingles_of(text, size)
                    if b is None:
                        sets.append(own)
                    elif any(100 * len(own & s) >= percent * len(own | s) for s in sets):
                        linked.append((a, b))
                columns = [pa.array(c, pa.int64()) for c in (zip(*linked) if linked else ([], []))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        return rows.mapInArrow(compare, "a long, b long").distinct()


def _runs(batches):
    """Of rows sorted by key and node, those whose key has more than one node, once each, with the first node."""
    held = None  # (key, node, first, already given) of the last row so far
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(key):
            continue
        if held:
            key, node = np.r_[held[0], key], np.r_[held[1], node]
        new = np.r_[True, key[1:] != key[:-1]]
        fresh = new | np.r_[True, node[1:] != node[:-1]]
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if held:
            first = np.where(key == held[0], held[2], first)
        starts = np.flatnonzero(new)
        size = np.add.reduceat(fresh.astype(np.int64), starts)[np.cumsum(new) - 1]
        if held:
            size = np.where(key == held[0], size + held[4], size)
        given = fresh & (size > 1)
        if held and held[3]:
            given[0] = False
        last = (key[-1], node[-1], first[-1])
        done = bool(size[-1] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[given]) for x in (key, node, first)], names=["key", "node", "first"])
        # Nodes of the last key seen before the held row.
        held = (*last, done, int(size[-1]) - 1)


def _blocks(batches):
    """Arrays of the rows of each ``(key, i, j)``, in turn."""
    group, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j, own, node, part, n = (batch.column(c).to_numpy() for c in range(7))
        words, ends = batch.column(7).values.to_numpy(), batch.column(7).offsets.to_numpy()
        marks = np.empty(len(key), object)
        marks[:] = [words[x:y].view(np.uint64) for x, y in zip(ends[:-1], ends[1:])]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(starts, [*starts[1:], len(key)]):
            here = (key[a], i[a], j[a])
            if here != group and parts:
                yield group, [np.concatenate(x) for x in zip(*parts)]
                parts = []
            group = here
            parts.append([x[a:b] for x in (own, node, part, n, marks)])
    if parts:
        yield group, [np.concatenate(x) for x in zip(*parts)]


def _close_pairs(block, percent: int, nearest: bool = False):
    (_, i, j), (own, node, part, n, marks) = block
    size = min(map(len, marks))
    marks = np.stack([folded(x, size) for x in marks])
    left = np.flatnonzero(own == i)
    right = np.flatnonzero(own == j)
    pairs = set()
    for start in range(0, len(left), 64):
        rows = left[start : start + 64]
        total = n[rows][:, None] + n[right]
        small, large = np.minimum(n[rows][:, None], n[right]), np.maximum(n[rows][:, None], n[right])
        near = (part[rows][:, None] != part[right]) & (100 * small >= percent * large)
        x, y = np.nonzero(near)
        apart = np.bitwise_count(marks[rows[x]] ^ marks[right[y]]).sum(1)
        close = apart <= total[x, y] * (100 - percent) // (100 + percent)
        x, y, apart = x[close], y[close], apart[close]
        if nearest:
            # The first of each set, the closest first.
            order = np.lexsort((node[right[y]], apart, x))
            first = order[np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])] if len(x) else order
            x, y = x[first], y[first]
        pairs.update((min(a, b), max(a, b)) for a, b in zip(node[rows[x]].tolist(), node[right[y]].tolist()) if a != b)
    if pairs:
        columns = [pa.array(c, pa.int64()) for c in zip(*sorted(pairs))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without documents that reach one of smaller id by links; all columns stay."""
    groups = Join(docs, size, percent, id_col, text_col).groups()
    dropped = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    doubtful, sure = split_by(docs, dropped, {"dropped_id": F.col(id_col)})
    rows = doubtful.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"))
    rows = rows.join(dropped, F.col("row_id") == F.col("dropped_id"), "left_anti")
    return sure.unionByName(rows.select("row.*"))

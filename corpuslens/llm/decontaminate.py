"""Benchmark decontamination: passages of benchmark items in documents, within an edit budget.

Texts are compared lower-cased with white space runs as one space. An item of length n may differ by
``floor(ERROR_RATE * n)`` edits. It is cut into one piece more than that, so at least one piece occurs unchanged in any
match (pigeonhole). One automaton finds all pieces of a block of items in a document; the surroundings of each hit are
verified with Myers' bit-parallel edit distance, the bits in one long integer. Items are taken in blocks of bounded size,
each a pass over the documents, so nothing unbounded is sent to the executors.

Defined results: null, empty or blank documents and items match nothing; items under ``1 / ERROR_RATE`` characters must
occur unchanged; equal items match each for itself; of several places in a document the one with the fewest edits is
given, then the first; repeated rows give repeated results; empty tables give an empty table. Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import id_and_text, map_texts
from corpuslens.session import written

ERROR_RATE = 0.06
# Characters of items in one block; the automaton takes some twenty times as many bytes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str) -> int:
    return int(ERROR_RATE * len(item))


def cut(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget(item) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def best_match(item: str, window: str, limit: int) -> tuple[int, int] | None:
    """Fewest edits between ``item`` and any part of ``window``, and the first end of such a part (Myers 1999)."""
    n = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, char in enumerate(item):
        masks[char] |= 1 << i
    ones, top = (1 << n) - 1, 1 << (n - 1)
    rises, falls, score, best = ones, 0, n, None
    for end, char in enumerate(window, 1):
        equal, falls_before = masks.get(char, 0), falls
        diagonal = (((equal & rises) + rises) ^ rises) | equal | falls
        up = falls | (ones & ~(diagonal | rises))
        down = rises & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & ones, (down << 1) & ones
        vertical = equal | falls_before
        rises = down | (ones & ~(vertical | up))
        falls = up & vertical
        if score <= limit and (best is None or score < best[0]):
            best = (score, end)
    return best


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for offset, piece in cut(text):
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, edits)`` in the normalised text; the start is right for unchanged items and else
        the end less the item's length."""
        text, found, windows = normal(text), {}, defaultdict(list)
        if self.empty or not text:
            return []
        for last, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                start, item = last + 1 - length - offset, self.items[k][1]
                if k in found and found[k][2] == 0:
                    continue
                if start >= 0 and text.startswith(item, start):
                    found[k] = (start, start + len(item), 0)
                elif budget(item):
                    windows[k].append(start)
        for k, starts in windows.items():
            if k in found:
                continue
            item = self.items[k][1]
            slack = budget(item)
            for low, high in _merge(starts, slack, len(item)):
                low = max(0, low)
                match = best_match(item, text[low:high], slack)
                if match and (k not in found or match[0] < found[k][2]):
                    end = low + match[1]
                    found[k] = (max(0, end - len(item)), end, match[0])
        return [(self.items[k][0], *found[k]) for k in sorted(found)]


def _merge(starts: list[int], slack: int, length: int):
    """Windows around the supposed starts, overlapping ones joined."""
    low = high = None
    for start in sorted(set(starts)):
        if low is not None and start - slack <= high:
            high = max(high, start + length + slack)
        else:
            if low is not None:
                yield low, high
            low, high = start - slack, start + length + slack
    if low is not None:
        yield low, high


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items, normalised and without blank ones, in lists of bounded size.

    Only one block at a time is on the driver.
    """
    rows = id_and_text(benchmark, id_col, text_col)
    rows = written(rows.select("doc_id", "text", F.length("text").alias("n")), "items")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // BLOCK_CHARS))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(count)) == k) if count > 1 else rows
        items = [(row.doc_id, normal(row.text)) for row in part.toLocalIterator()]
        yield sorted(((i, t) for i, t in items if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for every item found in a document."""
    texts, found = id_and_text(docs, id_col, text_col), None
    for items in blocks(benchmark):
        part = map_texts(texts, _searcher(items), "doc_id long, item_id long, start int, end int, edits int")
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(items):
    def start():
        search = Items(items)

        def work(ids, texts):
            rows = [(i, *match) for i, text in zip(ids, texts) for match in search.matches(text)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "start", "end", "edits"])

        return work

    return start


def contains(items) -> Column:
    """Whether a text holds any item of the block, as a column function."""
    cache = []

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Items(items))
        return pd.Series([bool(cache[0].matches(text or "")) for text in texts], dtype=bool)

    return of


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without any benchmark item, with all their columns and without a shuffle."""
    for items in blocks(benchmark):
        docs = docs.where(~contains(items)(F.col(text_col)))
    return docs

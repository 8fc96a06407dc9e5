"""Counting 1-2-grams of cleaned texts in Arrow batches, with numpy.

A slice of a batch is a few thousand rows. Words are numbered per slice and a term is one or
two numbers, so that counting is a sort of integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows and words that are worked on at a time; a longer text is a slice of its own.
ROWS = 2048
WORDS = 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """The batch in slices, with the words of two or more characters and the row of each."""
    for start in range(0, batch.num_rows, ROWS):
        waiting = [batch.slice(start, ROWS)]
        while waiting:
            part = waiting.pop()
            lists = pc.split_pattern(part.column("clean").cast(pa.large_string()), " ")
            if part.num_rows > 1 and len(lists.flatten()) > WORDS:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
                continue
            words = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            kept = pc.greater_equal(pc.binary_length(words), 2)
            yield part, words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(group, clean)``: ``(group, term, total, df)`` of every slice."""
    for batch in batches:
        for part, words, row in slices(batch):
            if not len(words):
                continue
            coded = words.dictionary_encode()
            names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            groups = part.column("group").dictionary_encode(null_encoding="encode")
            group = groups.indices.to_numpy().astype(np.int64)[row]
            # 0 as the second word stands for none.
            n_words, n_rows = len(names) + 1, part.num_rows
            pairs = row[1:] == row[:-1]
            term = group * n_words + word
            terms = np.concatenate([term * n_words, (term[:-1] * n_words + word[1:] + 1)[pairs]])
            seen = np.sort(terms * n_rows + np.concatenate([row, row[1:][pairs]]))
            term = seen // n_rows
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            term, total = term[starts], np.diff(np.r_[starts, len(seen)])
            in_rows = np.add.reduceat(np.r_[True, seen[1:] != seen[:-1]].astype(np.int64), starts)
            first, second = term // n_words, term % n_words
            one = second == 0
            text = names.take(pa.array(first % n_words))
            # Terms of one word and of two, each put together whole.
            order = np.concatenate([np.flatnonzero(one), np.flatnonzero(~one)])
            more = names.take(pa.array(second[~one] - 1))
            text = pa.concat_arrays([text.filter(pa.array(one)), pc.binary_join_element_wise(text.filter(pa.array(~one)), more, pa.scalar(" ", pa.large_string()))])
            of = groups.dictionary.take(pa.array((first // n_words)[order]))
            columns = [of, text.cast(pa.string()), pa.array(total[order]), pa.array(in_rows[order])]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "term", "total", "df"])


class _Vocabulary:
    """Terms ``(group, term, index, idf)``, found by numbers of their words; positions ascend by group and index."""

    def __init__(self, table: pa.Table):
        table = table.filter(pc.is_valid(table["group"])).combine_chunks()
        self.groups = pc.unique(table["group"])
        group = pc.index_in(table["group"], self.groups).to_numpy().astype(np.int64)
        index = table["index"].to_numpy()
        order = np.lexsort((index, group))
        self.terms = table["term"].combine_chunks().cast(pa.large_string()).take(pa.array(order))
        self.index, self.idf = index[order].astype(np.int32), table["idf"].to_numpy()[order]
        parts = pc.split_pattern(self.terms, " ")
        first, last = pc.list_element(parts, 0), pc.list_slice(parts, 1, 2)
        last = [x[0] if x else None for x in last.to_pylist()]
        last = pa.array(last, pa.large_string())
        self.words = pc.unique(pa.concat_arrays([first, last.drop_null()]))
        self.n = len(self.words) + 1
        second = pc.fill_null(pc.index_in(last, self.words), -1).to_numpy().astype(np.int64) + 1
        key = (group[order] * self.n + pc.index_in(first, self.words).to_numpy()) * self.n + second
        self.place = np.argsort(key)
        self.keys = key[self.place]

    def cells(self, part: pa.RecordBatch, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and position of every occurrence of a known term."""
        coded = words.dictionary_encode()
        if not len(self.keys) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy().astype(np.int64)
        word = known[coded.indices.to_numpy()]
        group = pc.fill_null(pc.index_in(part.column("group"), self.groups), -1).to_numpy().astype(np.int64)[row]
        has = (word >= 0) & (group >= 0)
        both = has[:-1] & has[1:] & (row[1:] == row[:-1])
        start = (group * self.n + word) * self.n
        keys = np.concatenate([start[has], start[:-1][both] + word[1:][both] + 1])
        rows = np.concatenate([row[has], row[:-1][both]])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return rows[found], self.place[at[found]]


def weigh_terms(table: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``(group, key, clean)`` sorted by group and key: ``(group, key, terms, indices, weights)``.

    Rows that share group and key are one text. ``table`` is ``(group, term, index, idf)``.
    """

    def weighed(keys: pa.RecordBatch, run: np.ndarray, place: np.ndarray, tf: np.ndarray, vocabulary: _Vocabulary) -> pa.RecordBatch:
        weight = (1.0 + np.log(tf)) * vocabulary.idf[place]
        weight = weight / np.sqrt(np.bincount(run, weight * weight, keys.num_rows))[run]
        sizes = np.bincount(run, minlength=keys.num_rows)
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        columns = [
            *keys.columns,
            pa.ListArray.from_arrays(ends, vocabulary.terms.take(pa.array(place)).cast(pa.string())),
            pa.ListArray.from_arrays(ends, pa.array(vocabulary.index[place])),
            pa.ListArray.from_arrays(ends, pa.array(weight)),
        ]
        found = pa.RecordBatch.from_arrays(columns, names=["group", "key", "terms", "indices", "weights"])
        return found.filter(pa.array(sizes > 0))

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(table)
        n = max(len(vocabulary.keys), 1)
        held = None  # keys, places and counts of the last key so far
        for batch in batches:
            for part, words, row in slices(batch):
                keys = part.select(["group", "key"])
                names = list(zip(*(c.to_pylist() for c in keys.columns)))
                new = np.array([True, *(a != b for a, b in zip(names, names[1:]))])
                run = np.cumsum(new) - 1
                rows, place = vocabulary.cells(part, words, row)
                cells, tf = np.unique(run[rows] * n + place, return_counts=True)
                if held and held[0] == names[0]:
                    cells = np.concatenate([held[2], cells])
                    cells, inverse = np.unique(cells, return_inverse=True)
                    tf = np.bincount(inverse, np.concatenate([held[3], tf])).astype(np.int64)
                elif held:
                    yield weighed(held[1], np.zeros(len(held[2]), np.int64), held[2], held[3], vocabulary)
                run, place = cells // n, cells % n
                firsts = keys.take(pa.array(np.flatnonzero(new)))
                last = firsts.num_rows - 1
                done = run < last
                held = names[-1], firsts.slice(last), place[~done], tf[~done]
                if last:
                    yield weighed(firsts.slice(0, last), run[done], place[done], tf[done], vocabulary)
        if held:
            yield weighed(held[1], np.zeros(len(held[2]), np.int64), held[2], held[3], vocabulary)

    return run_batches

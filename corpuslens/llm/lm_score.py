"""Documents scored by masked pseudo-likelihood: each word is predicted from the words on both sides of it.

Frequent words are symbols of their own, others share a symbol by their ending. Spark counts words, and then how often
each symbol stands between each pair of neighbours, over the whole corpus. These counts, whose number of cells is fixed,
are all that the network learns from: the two neighbours are embedded, added and bent, and give a softmax over the
symbols; it is trained in numpy until it has seen every count ``EPOCHS`` times. A word's log-probability is that of its
symbol between its neighbours, plus that of the word among the words of its symbol. A document's score is the sum.

Defined results: null or blank text has no word and a sum and mean of 0; an empty corpus predicts all symbols alike; rows
that repeat count twice and get equal scores; an empty table gives an empty table. Only the id and text column are read,
so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Memo, id_and_text, map_texts
from corpuslens.session import written

SYMBOLS, OWN, WIDTH, EPOCHS, RATE, SEED = 128, 95, 24, 150, 0.05, 11
# Words whose own count is kept; rarer ones share what their symbol has left.
VOCABULARY = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]")
EDGE = 0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def ending(word: str) -> int:
    """Symbol of a word without one of its own."""
    return OWN + 1 + zlib.crc32(word[-2:].encode()) % (SYMBOLS - OWN - 1)


@dataclass
class Words:
    """Symbols and counts of the most frequent words, and per symbol: all tokens, tokens and kinds of the rarer words."""

    count: dict[str, int]
    own: dict[str, int]
    totals: np.ndarray
    rest: np.ndarray
    kinds: np.ndarray

    def symbol(self, word: str) -> int:
        return self.own.get(word) or ending(word)

    def log_share(self, word: str) -> float:
        """Log-probability of the word among those with its symbol."""
        symbol = self.symbol(word)
        if symbol <= OWN:
            return 0.0
        known = self.count.get(word)
        part = known if known else max(self.rest[symbol], 1) / max(self.kinds[symbol], 1)
        return float(np.log(part / max(self.totals[symbol], part)))


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""

    def start():
        def work(ids, texts):
            counts = Counter()
            for text in texts:
                counts.update(tokens(text))
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        return work

    return map_texts(texts, start, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_words(texts: DataFrame) -> Words:
    counts = written(count_words(texts), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    count = {row.word: row.n for row in top}
    own = {word: k for k, word in enumerate(list(count)[:OWN], 1)}
    symbol = F.lit(OWN + 1) + F.crc32(F.expr("right(word, 2)")) % (SYMBOLS - OWN - 1)
    # One row per symbol.
    sums = counts.groupBy(symbol.alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    totals, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for row in sums:
        totals[row.symbol], kinds[row.symbol] = row.n, row.kinds
    rest = totals.copy()
    for word, n in count.items():
        rest[ending(word)] -= n
        kinds[ending(word)] -= 1
        if word in own:
            totals[ending(word)] -= n
            totals[own[word]] = n
    return Words(count, own, totals, rest, kinds)


def cells(symbols: np.ndarray) -> np.ndarray:
    """Left neighbour, symbol and right neighbour as one number for every place of a document."""
    edged = np.concatenate([[EDGE], symbols, [EDGE]])
    return (edged[:-2] * SYMBOLS + edged[1:-1]) * SYMBOLS + edged[2:]


def count_cells(texts: DataFrame, words: Words) -> np.ndarray:
    """How often each symbol stands between each pair, over all texts, as ``[left, symbol, right]``."""

    def run(batches):
        symbol = Memo(words.symbol)
        total, held, size = np.zeros(SYMBOLS**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                held.append(cells(np.fromiter(map(symbol.__getitem__, found), np.int64, len(found))))
                size += len(found)
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    counts = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # SYMBOLS ** 3 rows at most.
    table = written(counts, "cells").toArrow()
    total = np.zeros(SYMBOLS**3)
    total[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


@dataclass
class Network:
    left: np.ndarray
    right: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def train(cls, counts: np.ndarray) -> Network:
        """Adam on the cross-entropy of all counts; every pair of neighbours is one weighted example."""
        draw = np.random.default_rng(SEED)
        usual = counts.sum((0, 2)) + 1
        p = [0.3 * draw.standard_normal(s).astype(np.float32) for s in ((SYMBOLS, WIDTH), (SYMBOLS, WIDTH), (WIDTH, SYMBOLS))]
        p.append(np.log(usual / usual.sum()).astype(np.float32))
        pairs = counts.transpose(0, 2, 1).reshape(-1, SYMBOLS)
        rows = np.flatnonzero(pairs.sum(1))
        if not len(rows):
            return cls(*p)
        target = (pairs[rows] / pairs.sum()).astype(np.float32)
        mass, a, b = target.sum(1, keepdims=True), rows // SYMBOLS, rows % SYMBOLS
        # Sums by neighbour, as products with their indicators.
        from_a, from_b = (np.eye(SYMBOLS, dtype=np.float32)[x] for x in (a, b))
        mean, spread = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(p[0][a] + p[1][b])
            logits = hidden @ p[2] + p[3]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            error = logits * (mass / logits.sum(1, keepdims=True)) - target
            inner = (error @ p[2].T) * (1 - hidden * hidden)
            slopes = [from_a.T @ inner, from_b.T @ inner, hidden.T @ error, error.sum(0)]
            rate = RATE * (1 - step / (EPOCHS + 1))
            for x, m, v, g in zip(p, mean, spread, slopes):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return cls(*p)

    def log_table(self) -> np.ndarray:
        """Log-probability of every cell."""
        a, b = np.divmod(np.arange(SYMBOLS**2), SYMBOLS)
        logits = np.tanh(self.left[a] + self.right[b]) @ self.out + self.bias
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits.reshape(SYMBOLS, SYMBOLS, SYMBOLS).transpose(0, 2, 1).ravel()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` for every row, by a network trained on all rows."""
    texts = id_and_text(docs, id_col, text_col)
    words = fit_words(texts)
    network = Network.train(count_cells(texts, words))

    def start():
        table = network.log_table()
        known = Memo(lambda word: (words.symbol(word), words.log_share(word)))

        def work(ids, texts):
            sums, sizes = [], []
            for text in texts:
                found = [known[word] for word in tokens(text)]
                symbols = np.fromiter((s for s, _ in found), np.int64, len(found))
                sizes.append(len(found))
                sums.append(float(table[cells(symbols)].sum(dtype=np.float64)) + sum(p for _, p in found))
            means = [s / max(1, n) for s, n in zip(sums, sizes)]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "log_prob", "mean_log_prob"])

        return work

    return map_texts(texts, start, "doc_id long, n_words long, log_prob double, mean_log_prob double")

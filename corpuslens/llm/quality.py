"""Quality by ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel. Each task sums its part of the normal equations, per fold; the sums are added
in two levels and solved on the driver, whose share is a fixed matrix size. Scores of held-out folds are binned, and a
rising step function (pooled neighbours) maps them to probabilities, with straight lines between the steps.

Defined results: null or empty text has all statistics 0 and a score like any other; ties and repeated rows get equal
scores; without labelled rows of both kinds every score is the share of good labels (0 without any); an empty table
gives an empty table. Only id, text and label are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import id_and_text, map_texts
from corpuslens.session import written

FEATURES, FOLDS, RIDGE, SEED, BINS = 256, 4, 1e-3, 7, 2000
NAMES = (
    "words word_length distinct top_word repeats shouted upper digits marks stops symbols blanks other_bytes lines "
    "distinct_lines line_length"
).split()
_byte = np.zeros((7, 256))
for _row, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\v\f", bytes(range(128, 256)))
):
    _byte[_row, list(_chars)] = 1


def statistics(text: str) -> list[float]:
    """The document statistics in the order of ``NAMES``."""
    if not text:
        return [0.0] * len(NAMES)
    data = text.encode()
    kinds = _byte @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words, lines = text.split(), text.split("\n")
    n, counts = len(words), Counter(words)
    if not n:
        return [0.0] * 6 + kinds.tolist() + [np.log1p(len(lines)), 0.0, 0.0]
    return [
        np.log1p(n),
        sum(map(len, counts)) / len(counts),
        np.log1p(len(counts)) / np.log1p(n),
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        *kinds.tolist(),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` (array of double) for every row."""

    def start():
        def work(ids, texts):
            rows = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), rows], names=["doc_id", "stats"])

        return work

    return map_texts(id_and_text(docs, id_col, text_col), start, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # empty: constant
    steps: np.ndarray  # raw scores
    values: np.ndarray  # probabilities at the steps

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def predict(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.values[0])
        return np.interp(self.features(stats) @ self.weights, self.steps, self.values)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant; the draw depends on ``SEED`` alone."""
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((len(NAMES), FEATURES)) / np.sqrt(len(NAMES))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    waves = np.cos(np.clip(x, -5, 5) @ directions + phases) * np.sqrt(2 / FEATURES)
    return np.hstack([waves, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _sums(train: DataFrame, mean, scale) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations by fold: ``sum z z'`` and ``sum z y``."""
    size = FEATURES + 1

    def add(batches):
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y = fourier((matrix(batch.column(0)) - mean) / scale), batch.column(1).to_numpy()
            fold = batch.column(2).to_numpy()
            for k in range(FOLDS):
                part = z[fold == k]
                total[k] += part.T @ np.hstack([part, y[fold == k][:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def join(batches):
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = train.select("stats", F.col("label").cast("double"), "fold").mapInArrow(add, "sums binary")
    parts = parts.repartition(8).mapInArrow(join, "sums binary").toLocalIterator()
    total = sum(np.frombuffer(row.sums).reshape(FOLDS, size, size + 1) for row in parts)
    return total[:, :, :-1], total[:, :, -1]


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    rows = max(gram[-1, -1], 1.0)
    return np.linalg.solve(gram + RIDGE * rows * np.eye(len(gram)) / FEATURES, right)


def isotonic(x: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising least-squares fit of ``good / total`` by pooling neighbours; block centres and their values."""
    blocks: list[list[float]] = []
    for row in zip(x * total, good, total):
        blocks.append(list(map(float, row)))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centres, goods, totals = np.array(blocks).T
    return centres / totals, goods / totals


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``stats (doc_id, stats)`` and ``labels (doc_id, label)``, all labelled rows."""
    rows = stats.join(labels.where("label IN (0, 1)").select("doc_id", "label"), "doc_id")
    fold = F.expr(f"int(pmod(xxhash64(stats), {FOLDS}))").alias("fold")
    rows = written(rows.select("stats", "label", fold), "quality-train")
    moments = [F.avg(F.col("stats")[i]) for i in range(len(NAMES))] + [F.stddev_pop(F.col("stats")[i]) for i in range(len(NAMES))]
    found = rows.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.0)), *moments).first()
    n, share = found[0], float(found[1])
    if share in (0.0, 1.0):
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.array([]), np.array([0.0]), np.array([share]))
    mean, scale = np.array(found[2 : 2 + len(NAMES)], float), np.array(found[2 + len(NAMES) :], float)
    scale = np.where(scale > 1e-9, scale, 1.0)
    gram, right = _sums(rows, mean, scale)
    held = [_solve(gram.sum(0) - gram[k], right.sum(0) - right[k]) for k in range(FOLDS)]

    def score(batches):
        for batch in batches:
            raw = (fourier((matrix(batch.column(0)) - mean) / scale) * np.array(held)[batch.column(2).to_numpy()]).sum(1)
            place = np.clip(np.round((raw + 0.5) * BINS / 2), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["place", "label"])

    scored = rows.select("stats", F.col("label").cast("double"), "fold").mapInArrow(score, "place int, label double")
    # At most BINS + 1 rows.
    bins = scored.groupBy("place").agg(F.sum("label").alias("good"), F.count("*").alias("n")).toPandas().sort_values("place")
    steps, values = isotonic(bins.place.to_numpy() * 2 / BINS - 0.5, bins.good.to_numpy(), bins.n.to_numpy())
    return Model(mean, scale, _solve(gram.sum(0), right.sum(0)), steps, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``stats``."""

    def run(batches):
        for batch in batches:
            scores = model.predict(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")

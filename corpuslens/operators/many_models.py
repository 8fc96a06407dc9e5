"""Many class-weighted logistic regressions over one stored table, by Newton steps in lock-step.

Rows lie in parts (dataset and fold, say) and a fit names the parts that train it, the parts it is tested on and the
vector columns it sees. Every pass over the table adds up, for all fits at once, what each of them needs next: value,
gradient and curvature at its weights, or the product of its Hessian with a direction. What leaves a task are these sums.
The Newton equations are solved by conjugate gradients, preconditioned by the exact curvature of the first (dense)
columns and the diagonal of the others, so the scale of a column does not matter; a fit takes tens of passes.

Objective: half the squared length of the weights plus the sum of balanced weight times log-loss; the intercept is free.
"""

from __future__ import annotations

import logging
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import written

LOGGER = logging.getLogger(__name__)

# Limit of solver iterations.
MAX_ITER = 1000
# The leading vector columns whose curvature is kept in full have at most this many cells together.
FULL_CURVATURE = 512
# Squared length of the last Newton step, by the curvature, against the objective.
TOLERANCE = 1e-9
INNER = 60
# Scores above count as label 1; one half up to rounding does not.
HALF = 0.5 + 1e-9
# Cells that a task works on at a time.
CELLS = 1_000_000
# Bytes of partial sums that the driver adds up itself; beyond that they are summed per fit on the executors first.
FAN_IN = 32_000_000


@dataclass(frozen=True)
class ManyFit:
    """One model to train: parts of the table and vector columns."""

    train: frozenset[int]
    test: frozenset[int] = frozenset()
    vectors: tuple[str, ...] | None = None


@dataclass
class LogisticModel:
    """Weights over the concatenated vector columns (0 where the fit does not look) and how the fit ended.

    ``gradient_norm`` is the length of the gradient, columns scaled by the curvature, against that of the zero model.
    """

    coefficients: np.ndarray
    intercept: float
    iterations: int
    limit_reached: bool
    gradient_norm: float
    columns: tuple[str, ...] = ()


@dataclass
class _Columns:
    """Vector columns of a table, side by side."""

    names: tuple[str, ...]
    starts: dict[str, int] = field(default_factory=dict)
    size: int = 0
    leading: int | None = None

    @classmethod
    def of(cls, store: DataFrame, names: Sequence[str], leading: int | None = None) -> _Columns:
        found = cls(tuple(names), leading=leading)
        first = store.select(*names).first()
        for name in names:
            found.starts[name] = found.size
            found.size += first[name].size if first else 0
        return found

    def of_fit(self, fit: ManyFit) -> np.ndarray:
        """Numbers of the fit's columns; the intercept comes last."""
        ends = [*list(self.starts.values())[1:], self.size]
        parts = [np.arange(start, end) for (name, start), end in zip(self.starts.items(), ends) if fit.vectors is None or name in fit.vectors]
        return np.concatenate([*parts, [self.size]]).astype(np.int64)

    def full(self) -> int:
        """How many leading cells get their curvature in full: those named, else whole vector columns."""
        if self.leading is not None:
            return min(self.leading, FULL_CURVATURE, self.size)
        ends = [*list(self.starts.values())[1:], self.size]
        return max([0, *(end for end in ends if end <= FULL_CURVATURE)])

    def cells(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of every cell of a batch."""
        parts = []
        for name in self.names:
            vector = batch.column(name)
            values, sizes = vector.field("values"), pc.list_value_length(vector.field("values")).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            is_sparse = np.repeat(vector.field("type").to_numpy(zero_copy_only=False) == 0, sizes)
            places[is_sparse] = vector.field("indices").flatten().to_numpy()
            parts.append((rows, places + self.starts[name], values.flatten().to_numpy()))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def slices(self, batches: Iterator[pa.RecordBatch], dense: int = 0) -> Iterator[tuple[pa.RecordBatch, _Cells]]:
        """The batches in slices with their cells, as many as are worked on at a time; ``dense`` cells of each row count anyway."""
        for batch in batches:
            waiting = [batch]
            while waiting:
                part = waiting.pop()
                rows, columns, values = self.cells(part)
                if part.num_rows > 1 and len(values) + part.num_rows * dense > CELLS:
                    half = part.num_rows // 2
                    waiting += [part.slice(half), part.slice(0, half)]
                    continue
                yield part, _Cells(part.num_rows, self.size, rows, columns, values)


class _Cells:
    """Cells of a few rows, as a sparse matrix whose last column, the intercept, is all 1."""

    def __init__(self, n_rows: int, size: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        kept = values != 0
        self.n_rows, self.size = n_rows, size
        self.rows, self.columns, self.values = rows[kept], columns[kept], values[kept]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """``[row, i]``: the rows times every row of ``weights``."""
        found = [np.bincount(self.rows, self.values * w[self.columns], self.n_rows) + w[-1] for w in weights]
        return np.stack(found, 1) if found else np.zeros((self.n_rows, 0))

    def pack(self, part: np.ndarray, label: np.ndarray, leading: int) -> Iterator[dict]:
        """The rows of each part in the layout that :class:`_Block` reads."""
        dense = np.zeros((self.n_rows, leading))
        own = self.columns < leading
        dense[self.rows[own], self.columns[own]] = self.values[own]
        rows, columns, values = self.rows[~own], self.columns[~own], self.values[~own]
        for number in np.unique(part):
            chosen = part == number
            cells = chosen[rows]
            place = np.cumsum(chosen) - 1
            yield {
                "part": int(number),
                "label": label[chosen].astype(np.int8).tobytes(),
                "dense": dense[chosen].tobytes(),
                "rows": place[rows[cells]].astype(np.int32).tobytes(),
                "columns": columns[cells].astype(np.int32).tobytes(),
                "values": values[cells].astype(np.float64).tobytes(),
            }


BLOCK = "part int, label binary, dense binary, rows binary, columns binary, values binary"


class _Block:
    """Rows of one part: leading columns as a dense matrix, the others as cells. The last column, the intercept, is all 1."""

    def __init__(self, label: bytes, dense: bytes, rows: bytes, columns: bytes, values: bytes, leading: int, size: int):
        self.label = np.frombuffer(label, np.int8).astype(int)
        self.leading, self.size, self.n_rows = leading, size, len(self.label)
        self.dense = np.frombuffer(dense, np.float64).reshape(self.n_rows, leading)
        # What numpy takes as an index without a copy.
        self.rows, self.columns = (np.frombuffer(x, np.int32).astype(np.intp) for x in (rows, columns))
        self.values = np.frombuffer(values, np.float64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """``[row, i]``: the rows times every row of ``weights``."""
        found = self.dense @ weights[:, : self.leading].T + weights[:, -1]
        if len(self.values):
            for i, w in enumerate(weights):
                found[:, i] += np.bincount(self.rows, self.values * w[self.columns], self.n_rows)
        return found

    def summed(self, factors: np.ndarray, squared: bool = False) -> np.ndarray:
        """``[i, column]``: the sum of the rows (or of their squares) times each column of ``factors``."""
        values, dense = (self.values * self.values, self.dense * self.dense) if squared else (self.values, self.dense)
        out = np.zeros((factors.shape[1], self.size + 1))
        if len(values):
            for i, factor in enumerate(factors.T):
                out[i, :-1] = np.bincount(self.columns, values * factor[self.rows], self.size)
        out[:, : self.leading] = factors.T @ dense
        out[:, -1] = factors.sum(0)
        return out

    def curvature(self, factors: np.ndarray) -> np.ndarray:
        """``[i]``: the products of the intercept and the leading columns with each other, times each column of ``factors``."""
        own = np.concatenate([np.ones((self.n_rows, 1)), self.dense], 1)
        out = np.empty((factors.shape[1], self.leading + 1, self.leading + 1))
        for i, factor in enumerate(factors.T):
            out[i] = own.T @ (factor[:, None] * own)
        return out


def _packed(store: DataFrame, columns: _Columns, vectors: Sequence[str], part: str) -> DataFrame:
    """The store as blocks of rows of one part, written once: the passes read numpy's own layout instead of vectors."""
    leading = columns.full()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cells in columns.slices(batches, leading):
            number, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "label"))
            yield pa.RecordBatch.from_pylist(list(cells.pack(number, label, leading)), _BLOCK_SCHEMA)

    rows = store.select(F.col(part).alias("part"), "label", *vectors)
    return written(rows.mapInArrow(run, BLOCK), "blocks")


_BLOCK_SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.binary()) for name, kind in (c.split() for c in BLOCK.split(", "))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class _Preconditioner:
    """Inverse of the curvature's leading block, and of the diagonal beyond it."""

    def __init__(self, diagonal: np.ndarray, block: np.ndarray):
        self.diagonal, n = diagonal, len(block)
        self.n, self.scale = n, 1 / np.sqrt(np.maximum(np.diag(block), 1e-300))
        values, self.vectors = np.linalg.eigh(block * self.scale[:, None] * self.scale)
        self.values = np.maximum(values, 1e-12)

    def solve(self, r: np.ndarray) -> np.ndarray:
        out = r / self.diagonal
        leading = self.vectors.T @ (r[: self.n] * self.scale)
        out[: self.n] = self.scale * (self.vectors @ (leading / self.values))
        return out


def _newton(penalty: np.ndarray, n_full: int, max_iter: int, tolerance: float) -> Generator:
    """Asks for ``(weights, None)`` or ``(weights, direction)``; gets sums of the rows. Intercept and full block come first."""

    def with_penalty(sums, w):
        loss, gradient, diagonal, block = sums
        block = block + np.diag(penalty[:n_full])
        return loss + 0.5 * (penalty * w * w).sum(), gradient + penalty * w, np.maximum(diagonal + penalty, 1e-12), block

    w = np.zeros(len(penalty))
    value, gradient, diagonal, block = with_penalty((yield w, None), w)
    scaled = _Preconditioner(diagonal, block)
    first = max(gradient @ scaled.solve(gradient), 1e-300)
    for iteration in range(max_iter + 1):
        decrement = gradient @ scaled.solve(gradient)
        norm = float(np.sqrt(max(decrement, 0.0) / first))
        if decrement <= tolerance * max(1.0, value) or iteration == max_iter:
            return w, iteration, decrement > tolerance * max(1.0, value), norm
        step, rest = np.zeros_like(w), -gradient
        direction = scaled.solve(rest)
        size = start = rest @ direction
        goal = min(0.1, np.sqrt(norm)) ** 2 * start
        for _ in range(INNER):
            curved = (yield w, direction) + penalty * direction
            along = size / (direction @ curved)
            step += along * direction
            rest -= along * curved
            solved = scaled.solve(rest)
            before, size = size, rest @ solved
            if size <= goal:
                break
            direction = solved + size / before * direction
        slope, share = gradient @ step, 1.0
        while True:
            there = w + share * step
            found = with_penalty((yield there, None), there)
            if found[0] <= value + 1e-4 * share * slope + 1e-13 * abs(value) or share < 1e-6:
                break
            share /= 2
        if share < 1e-6:
            # Rounding hides any further gain.
            return w, iteration, decrement > 1e-6 * max(1.0, value), norm
        w, (value, gradient, diagonal, block) = there, found
        scaled = _Preconditioner(diagonal, block)


def _class_weights(store: DataFrame, fits: Sequence[ManyFit], part: str) -> np.ndarray:
    """``[fit, part, label]``: n / (2 * class size) where the part trains the fit, else 0. A part is a row of the counts."""
    counts = {(r["part"], r["label"]): r["count"] for r in store.groupBy(F.col(part).alias("part"), "label").count().collect()}
    n_parts = 1 + max([0, *(p for p, _ in counts), *(p for fit in fits for p in fit.train | fit.test)])
    weights = np.zeros((len(fits), n_parts, 2))
    for i, fit in enumerate(fits):
        sizes = [sum(counts.get((p, label), 0) for p in fit.train) for label in (0, 1)]
        if not all(sizes):
            raise ValueError(f"training rows need labels 0 and 1, got {sizes} of them")
        for p in fit.train:
            weights[i, p] = [sum(sizes) / (2 * n) for n in sizes]
    return weights


def fit_many(
    store: DataFrame, fits: Sequence[ManyFit], vectors: Sequence[str], part: str = "part", max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE, leading: int | None = None,
) -> list[LogisticModel]:
    """Train all ``fits`` on ``store (part int, label int, one ML vector per name of vectors)``.

    The vectors are read once and written as blocks (:func:`_packed`); every pass reads these. ``leading`` says
    how many columns are dense at the start, if that is not a number of whole vectors.
    """
    columns, weights = _Columns.of(store, vectors, leading), _class_weights(store, fits, part)
    leading = columns.full()
    solvers, numbers, full, asked, done = {}, {}, {}, {}, {}
    for i, fit in enumerate(fits):
        own = columns.of_fit(fit)
        # Intercept, cells with full curvature, others.
        numbers[i] = np.concatenate([own[-1:], own[:-1]])
        full[i] = 1 + int((own[:-1] < leading).sum())
        penalty = np.append(0.0, np.ones(len(own) - 1))
        solvers[i] = _newton(penalty, full[i], max_iter, tolerance)
        asked[i] = next(solvers[i])
    # Executors keep the blocks; what is lost or does not fit is read from the table again.
    blocks = _packed(store, columns, vectors, part).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    while asked:
        sums = _pass(blocks, columns, weights, {i: (numbers[i], full[i], *ask) for i, ask in asked.items()})
        for i in list(asked):
            try:
                asked[i] = solvers[i].send(sums[i])
            except StopIteration as end:
                done[i] = end.value
                del asked[i]
    blocks.unpersist()
    models = []
    for i in range(len(fits)):
        w, iterations, limit_reached, norm = done[i]
        whole = np.zeros(columns.size + 1)
        whole[numbers[i]] = w
        if limit_reached:
            LOGGER.warning("logistic fit stopped at its limit of %d iterations", max_iter)
        models.append(LogisticModel(whole[:-1], float(whole[-1]), iterations, bool(limit_reached), norm, columns.names))
    return models


def _pass(blocks: RDD, columns: _Columns, weights: np.ndarray, asked: dict) -> dict:
    """One scan: per fit what it asked for, summed over the rows that train it."""
    valued = [i for i, (*_, direction) in asked.items() if direction is None]
    curved = [i for i in asked if i not in valued]
    n = columns.size + 1

    def spread_out(i: int, x: np.ndarray) -> np.ndarray:
        whole = np.zeros(n)
        whole[asked[i][0]] = x
        return whole

    order = [*valued, *curved]
    at = np.stack([spread_out(i, asked[i][2]) for i in order])
    along = np.stack([spread_out(i, asked[i][3]) for i in curved]) if curved else np.zeros((0, n))
    of_fit, k, leading, size = weights[order], len(valued), columns.full(), columns.size

    def run(found: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        loss, gradient, diagonal = np.zeros(k), np.zeros((k, n)), np.zeros((k, n))
        full, product = np.zeros((k, leading + 1, leading + 1)), np.zeros(along.shape)
        for part, *packed in found:
            trained = of_fit[:, part].any(1)
            v, c = np.flatnonzero(trained[:k]), np.flatnonzero(trained[k:])
            if not len(v) + len(c):
                continue
            block = _Block(*packed, leading, size)
            label = block.label
            factor = of_fit[np.append(v, c + k)][:, part, label].T
            z = block.times(at[np.append(v, c + k)])
            p = sigmoid(z)
            bend = factor * p * (1 - p)
            if len(v):
                cv, zv = factor[:, : len(v)], z[:, : len(v)]
                loss[v] += (cv * (np.logaddexp(0, zv) - label[:, None] * zv)).sum(0)
                gradient[v] += block.summed(cv * (p[:, : len(v)] - label[:, None]))
                diagonal[v] += block.summed(bend[:, : len(v)], squared=True)
                full[v] += block.curvature(bend[:, : len(v)])
            if len(c):
                product[c] += block.summed(bend[:, len(v) :] * block.times(along[c]))
        for j in range(k):
            yield order[j], np.concatenate([[loss[j]], gradient[j], diagonal[j], full[j].ravel()])
        for j in range(len(curved)):
            yield order[k + j], product[j]

    partial = blocks.mapPartitions(run)
    if blocks.getNumPartitions() * 8 * (k * (1 + 2 * n + (leading + 1) ** 2) + len(curved) * n) > FAN_IN:
        partial = partial.reduceByKey(np.add, min(len(asked), blocks.getNumPartitions()))
    totals: dict[int, np.ndarray] = {}
    for i, found in partial.collect():
        totals[i] = totals[i] + found if i in totals else found
    out = {}
    for i, found in totals.items():
        own, n_full = asked[i][:2]
        if i in curved:
            out[i] = found[own]
        else:
            places = np.append(0, own[1:n_full] + 1)
            whole = found[1 + 2 * n :].reshape(leading + 1, leading + 1)
            out[i] = found[0], found[1 : n + 1][own], found[n + 1 : 2 * n + 1][own], whole[np.ix_(places, places)]
    return out


def score_many(store: DataFrame, fits: Sequence[ManyFit], models: Sequence[LogisticModel], keep: Sequence[str], part: str = "part") -> DataFrame:
    """``fit, *keep, prediction, score``: every row under every fit that its part tests, in one scan."""
    names = models[0].columns
    columns = _Columns.of(store, names)
    weights = np.stack([np.append(m.coefficients, m.intercept) for m in models])
    tested = np.zeros((len(fits), 1 + max([0, *(p for fit in fits for p in fit.train | fit.test)])), bool)
    for i, fit in enumerate(fits):
        tested[i, list(fit.test)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cells in columns.slices(batches):
            row, fit = np.nonzero(tested[:, batch.column("_part").to_numpy()].T)
            z = cells.times(weights)[row, fit]
            kept = [batch.column(c).take(pa.array(row)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fit, pa.int32()), *kept, pa.array((sigmoid(z) > HALF).astype(np.int32)), pa.array(sigmoid(z))],
                names=["fit", *keep, "prediction", "score"],
            )

    rows = store.select(*keep, F.col(part).alias("_part"), *names)
    schema = T.StructType([T.StructField("fit", T.IntegerType()), *(store.schema[c] for c in keep)])
    schema = schema.add("prediction", T.IntegerType()).add("score", T.DoubleType())
    return rows.mapInArrow(run, schema)

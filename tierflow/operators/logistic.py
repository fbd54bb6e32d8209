"""Fit of the penalised logistic regression (M5) by passes over sparse rows.

Spark ML's own fit works on features divided by their deviation. With the
penalty on the weights as they are (``standardization`` off), that makes the
penalty of a rare term thousands of times that of a common one, and the search
takes hundreds of passes. This one searches the weights themselves, each scaled
by a bound of its curvature. A pass is one Spark job: rows lie in blocks on the
executors, coefficients are broadcast, gradients are summed in a tree. The
driver holds what Spark ML's would: the coefficients and ten pairs of updates.

``fit_by_terms`` is for a vocabulary of any size: there the driver holds
vectors of a number a row, never one a term.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block, unless one row alone has more.
BLOCK = 1 << 20
#: Pairs of updates kept.
PAIRS = 10

_BLOCKS = "n binary, indices binary, weights binary, labels binary"


def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, indices, values) rows as blocks: cells of each row, their indices and values, labels."""
    for batch in batches:
        label, indices, values = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "indices", "values"))
        ends = np.cumsum(np.diff(indices.offsets.to_numpy()))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            rows = slice(start, stop - start)
            i, v = indices.slice(start, rows.stop), values.slice(start, rows.stop)
            cells = (np.diff(i.offsets.to_numpy()).astype(np.int32), i.flatten().to_numpy().astype(np.int32), v.flatten().to_numpy().astype(float), label.slice(start, rows.stop).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["n", "indices", "weights", "labels"])
            start = stop


def _cells(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(block[0], np.int32)
    return np.repeat(np.arange(len(n)), n), np.frombuffer(block[1], np.int32), np.frombuffer(block[2]), np.frombuffer(block[3])


def loss_and_gradient(blocks: Iterable, w: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss over the blocks, the intercept last, and behind it the loss."""
    out = np.zeros(len(w) + 1)
    for block in blocks:
        row, i, v, y = _cells(block)
        m = np.bincount(row, v * w[i], len(y)) + w[-1]
        r = 0.5 * (1.0 + np.tanh(0.5 * m)) - y
        out[:-2] += np.bincount(i, v * r[row], len(w) - 1)
        out[-2] += r.sum()
        out[-1] += (np.logaddexp(0.0, m) - y * m).sum()
    return out


def squares(blocks: Iterable, size: int) -> np.ndarray:
    """Sum of the squares of each feature's values, and the number of rows."""
    out = np.zeros(size + 1)
    for block in blocks:
        _, i, v, y = _cells(block)
        out[:-1] += np.bincount(i, v * v, size)
        out[-1] += len(y)
    return out


def fit(rows: DataFrame, size: int, C: float, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the summed log loss plus |w|^2 / (2 C).

    rows: label (double), indices (array of int), values (array of double).
    L-BFGS; ends when the gradient's norm is below tol^(2/3) of the one at
    zero (a weight is then off by at most C times that norm), when no step
    lowers the loss in double precision, or after ``max_iter`` steps.
    """
    sc = rows.sparkSession.sparkContext
    parts = max(rows.rdd.getNumPartitions(), sc.defaultParallelism)
    blocks = rows.repartition(parts).mapInArrow(to_blocks, _BLOCKS).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    penalty = np.append(np.full(size, 1.0 / C), 0.0)

    def total(of, arg) -> np.ndarray:
        sent = sc.broadcast(arg)
        found = blocks.mapPartitions(lambda part: [of(part, sent.value)]).treeReduce(np.add)
        sent.destroy()
        return found

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = total(loss_and_gradient, w)
        return found[-1] + 0.5 * float(penalty @ (w * w)), found[:-1] + penalty * w

    try:
        curve = 1.0 / np.maximum(penalty + 0.25 * total(squares, size), 1e-12)
        w = np.zeros(size + 1)
        loss, g = at(w)
        goal = tol ** (2.0 / 3.0) * np.linalg.norm(g)
        pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(max_iter):
            if np.linalg.norm(g) <= goal:
                break
            step = _direction(g, pairs, curve)
            slope, share = float(g @ step), 1.0
            while True:
                new_loss, new_g = at(w + share * step)
                # where the loss is at the end of its digits, the slope tells
                lower = new_loss <= loss + 1e-4 * share * slope or (new_loss <= loss + 1e-12 * abs(loss) and abs(float(new_g @ step)) <= 0.9 * abs(slope))
                if lower or share < 1e-6:
                    break
                share *= 0.5
            if not lower:
                break
            s, y = share * step, new_g - g
            if float(s @ y) > 0.0:
                pairs = [*pairs[1 - PAIRS:], (s, y, 1.0 / float(s @ y))]
            w, loss, g = w + s, new_loss, new_g
    finally:
        blocks.unpersist()
    return w[:-1], float(w[-1])


def _direction(g: np.ndarray, pairs: list, curve: np.ndarray) -> np.ndarray:
    """The quasi-Newton step from the pairs; ``curve`` is the inverse diagonal it starts from."""
    q, shares = g.copy(), []
    for s, y, rho in reversed(pairs):
        a = rho * float(s @ q)
        shares.append(a)
        q -= a * y
    scale = 1.0
    if pairs:
        s, y, rho = pairs[-1]
        scale = 1.0 / (rho * float(y @ (curve * y)))
    q *= scale * curve
    for (s, y, rho), a in zip(pairs, reversed(shares)):
        q += s * (a - rho * float(y @ q))
    return -q


def fit_by_terms(matrix, C: float, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """The same minimum over a ``term_blocks.TermMatrix`` X: a, where the weights are X' a, and the intercept.

    The gradient is X' (a / C + r), r being the rows' residuals, so that every
    step from zero is X' of some vector of rows, and a pass gives the image X X' v of
    a new one. A step is the lowest point over the gradient, the last ``PAIRS``
    steps and the intercept, found on the driver from their images. Ends as ``fit`` does.
    An id's copies count as often as ``fit`` meets them when rows are joined by id; a null id has no weight.
    """
    k = np.where(matrix.ids["id"].is_null().to_numpy(zero_copy_only=False), 0, matrix.ids["copies"].to_numpy())
    count, ones = (k * k).astype(float), k * matrix.ids["label"].to_numpy()
    a, image, b, goal = np.zeros(matrix.size), np.zeros(matrix.size), 0.0, None
    steps, images = np.empty((0, matrix.size)), np.empty((0, matrix.size))
    for _ in range(max_iter + 1):
        r = count * _sigmoid(image + b) - ones
        g = a / C + r
        found = matrix.gram(g)
        size = float(np.sqrt(max(float(g @ found), 0.0)))
        norm = float(np.hypot(size, r.sum()))
        goal = tol ** (2.0 / 3.0) * norm if goal is None else goal
        if norm <= goal:
            break
        scale = 1.0 / size if size > 0.0 else 0.0
        steps, images = np.vstack([steps[-PAIRS:], g * scale]), np.vstack([images[-PAIRS:], found * scale])
        t, shift = _lowest(steps, images, a, image + b, count, ones, C)
        s, of_s = t @ steps, t @ images
        length = float(np.sqrt(max(float(s @ of_s), 0.0)))
        if length == 0.0 and shift == 0.0:
            break
        a, image, b = a + s, image + of_s, b + shift
        # the step takes the gradient's place
        steps[-1], images[-1] = (s / length, of_s / length) if length else (0.0, 0.0)
    return a, b


#: Rows whose part of a curvature is worked out at once.
_STRETCH = 1 << 16


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * m))


def _lowest(steps: np.ndarray, images: np.ndarray, a: np.ndarray, m: np.ndarray, count: np.ndarray, ones: np.ndarray, C: float) -> tuple[np.ndarray, float]:
    """Newton's method over shares of the steps, and a shift of the intercept."""
    d = len(steps)
    inner, linear = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
    inner[:d, :d], linear[:d] = steps @ images.T / C, images @ a / C
    inner = 0.5 * (inner + inner.T)

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        now = m + x[:d] @ images + x[d]
        r = count * _sigmoid(now) - ones
        loss = float((count * np.logaddexp(0.0, now) - ones * now).sum() + 0.5 * x @ inner @ x + linear @ x)
        return loss, np.append(images @ r, r.sum()) + inner @ x + linear

    x = np.zeros(d + 1)
    loss, g = at(x)
    first = np.linalg.norm(g)
    for _ in range(20):
        if np.linalg.norm(g) <= 1e-4 * first:
            break
        curve = inner.copy()
        for s in range(0, len(m), _STRETCH):
            part = np.vstack([images[:, s:s + _STRETCH], np.ones(min(_STRETCH, len(m) - s))])
            p = _sigmoid(x @ part + m[s:s + _STRETCH])
            curve += (part * (count[s:s + _STRETCH] * p * (1.0 - p))) @ part.T
        step = -np.linalg.lstsq(curve, g, rcond=1e-14)[0]
        slope, share = float(g @ step), 1.0
        while True:
            new_loss, new_g = at(x + share * step)
            lower = new_loss <= loss + 1e-4 * share * slope or (new_loss <= loss + 1e-12 * abs(loss) and abs(float(new_g @ step)) <= 0.9 * abs(slope))
            if lower or share < 1e-6:
                break
            share *= 0.5
        if not lower:
            break
        x, loss, g = x + share * step, new_loss, new_g
    return x[:d], float(x[d])

"""Ridge regression over sparse postings, all folds at once, by conjugate gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest remaining error relative to the right-hand side, and most steps.
TOLERANCE, STEPS = 1e-8, 300


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every posting of a batch of documents."""
    sizes = batch["i"].map(len).to_numpy()
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.arange(len(batch)), sizes), np.concatenate(batch["i"].to_list()).astype(np.int64), np.concatenate(batch["w"].to_list()).astype(float)


class _Batch:
    """y, fold and postings of an Arrow batch, read from its buffers."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        i, w = batch.column("i"), batch.column("w")
        at, to = i.offsets.to_numpy(), w.offsets.to_numpy()
        self.n, self.y, self.fold = batch.num_rows, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "fold"))
        self.flat = np.repeat(np.arange(self.n), np.diff(at)), i.values.to_numpy()[at[0] : at[-1]].astype(np.int64), w.values.to_numpy()[to[0] : to[-1]]


def _product(row: np.ndarray, term: np.ndarray, weight: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """The rows' dot products with the columns of ``matrix``."""
    return np.column_stack([np.bincount(row, weight * column[term], n) for column in np.ascontiguousarray(matrix.T)])


def _spread(row: np.ndarray, term: np.ndarray, weight: np.ndarray, values: np.ndarray, n_terms: int) -> np.ndarray:
    return np.column_stack([np.bincount(term, weight * column[row], n_terms) for column in np.ascontiguousarray(values.T)])


def ridge_folds(rows: DataFrame, n_terms: int, alpha: float, n_folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts), a column for each fold: ridge with an unpenalised intercept on the labelled rows of the other folds.

    ``rows`` has y, fold, i and w. Every step is one pass over the rows for all folds together; the partitions' sums of n_terms x n_folds
    numbers meet in a tree, so the driver gets few of them. The vocabulary is bounded by its caps and so is what is sent out.
    """
    context, known = rows.sparkSession.sparkContext, rows.where("y is not null").select("y", "fold", "i", "w").persist(StorageLevel.MEMORY_AND_DISK)

    def gather(make) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = make(_Batch(batch))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["b"])

        parts = known.mapInArrow(run, "b binary").rdd.map(lambda r: np.frombuffer(bytes(r.b)))
        return parts.treeReduce(lambda a, b: a + b) if not parts.isEmpty() else None

    others = lambda batch: (batch.fold[:, None] != np.arange(n_folds)[None, :]).astype(float)

    def first(batch: _Batch) -> np.ndarray:
        mask, y, flat = others(batch), batch.y[:, None], batch.flat
        return np.concatenate([np.stack([mask.sum(axis=0), (mask * y).sum(axis=0)]), _spread(*flat, mask, n_terms), _spread(*flat, mask * y, n_terms)]).ravel()

    try:
        got = gather(first)
        if got is None:
            raise ValueError("ridge needs rows")
        got = got.reshape(-1, n_folds)
        n, y_mean = np.maximum(got[0], 1), got[1] / np.maximum(got[0], 1)
        x_mean, right = got[2 : 2 + n_terms] / n, got[2 + n_terms :] - got[2 : 2 + n_terms] * y_mean
        b, rest = np.zeros_like(right), right.copy()
        step, square = rest.copy(), (rest * rest).sum(axis=0)
        goal = np.maximum(square, 1e-300) * TOLERANCE**2
        for _ in range(STEPS):
            if (square <= goal).all():
                break
            sent = context.broadcast(step)

            def normal(batch: _Batch, sent=sent) -> np.ndarray:
                return _spread(*batch.flat, others(batch) * _product(*batch.flat, sent.value, batch.n), n_terms).ravel()

            image = gather(normal).reshape(-1, n_folds) - n * x_mean * (x_mean * step).sum(axis=0) + alpha * step
            sent.destroy()
            length = square / np.maximum((step * image).sum(axis=0), 1e-300)
            b, rest = b + length * step, rest - length * image
            now = (rest * rest).sum(axis=0)
            step, square = rest + now / np.maximum(square, 1e-300) * step, now
        return b, y_mean - (x_mean * b).sum(axis=0)
    finally:
        known.unpersist()


def ridge_oof(df: DataFrame, key: str, y: str, n_terms: int, alpha: float, n_folds: int = 5) -> DataFrame:
    """(key, y, fold, pred): every labelled row by the model of its fold, which never saw it, every unlabelled row by the mean of all.

    ``df`` has key, y, fold and the terms i and weights w of its document, null for a document without terms.
    """
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    rows = df.select(key, F.col(y).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), empty("i", "int"), empty("w", "double"))
    coefficients, intercepts = ridge_folds(rows, n_terms, alpha, n_folds)
    sent = df.sparkSession.sparkContext.broadcast((coefficients, intercepts))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, a = sent.value
        for batch in batches:
            every = _product(*_flat(batch), b, len(batch)) + a
            known = batch["y"].notna().to_numpy()
            own = every[np.arange(len(batch)), np.where(known, batch["fold"].fillna(0).to_numpy(), 0).astype(int)]
            yield pd.DataFrame({"key": batch[key], "y": batch["y"], "fold": batch["fold"].where(known), "pred": np.where(known, own, every.mean(axis=1))})

    made = rows.mapInPandas(predict, f"key {df.schema[key].dataType.simpleString()}, y double, fold int, pred double")
    return made.withColumnsRenamed({"key": key, "y": y})

"""Problem 5: the most similar vectors of a vector, by stable projections, a kd-tree and a chi-square stopping test.

Vectors are brought to unit length, so the order of cosines is that of distances. A few Gaussian (2-stable) projections are indexed by
a kd-tree. If a vector lies at distance d, its squared projected distance is d^2 times a chi-square variable of as many degrees as
projections. So neighbours are verified in order of projected distance, and a query ends once the next projected distance is so large
that a vector nearer than the present k-th would show it with a probability below ``MISS``.

The upper levels of the tree are cut from a bounded sample and divide all vectors into cells of about ``BLOCK`` rows; the lower ones are
built inside each cell. Every row is indexed. The k-th similarity of a query within the sample is a first bound, so a query is sent to
the cells that the stopping test does not rule out at once, and meets the rows of each in one task: the rows come first and become a
tree, the queries stream past it. Neither the rows nor the queries, be they all rows, are ever collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Projections, largest leaf, accepted probability to miss a neighbour at the stop, rows to a cell, rows of the sample.
PROJECTIONS, LEAF, MISS, BLOCK, SAMPLE = 4, 128, 0.05, 16_384, 8192

#: Queries that search a tree together, which bounds the memory of a task, and queries that scan a block together.
TOGETHER, SCANNED = 4096, 32
#: Cosines in single precision that differ by less may be equal.
TIE = 1e-5


def chi_square_quantile(degrees: int, probability: float) -> float:
    """By bisection on the closed form of the distribution for an even number of degrees."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < probability else (low, mid)
    return high


def unit_rows(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, float64 rows of length one) of the usable vectors: null, empty, wrongly sized, zero and non-finite ones drop out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros((0, max(width, 1)))
    rows = column.take(pa.array(at)).flatten()
    rows = np.asarray(rows.fill_null(np.nan), dtype=np.float64).reshape(len(at), width)
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], rows[good] / norm[good, None]


class Tree:
    """A kd-tree over the projections of one block, its rows stored leaf by leaf."""

    def __init__(self, rows: np.ndarray, axes: np.ndarray, leaf: int) -> None:
        low = rows @ axes
        order, bounds = np.arange(len(rows)), []
        stack = [(0, len(rows))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            part = low[order[a:b]]
            wide = int((part.max(axis=0) - part.min(axis=0)).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        self.order, self.bounds = order, bounds
        self.rows = rows[order].astype(np.float32)
        low = low[order]
        self.floor = np.stack([low[a:b].min(axis=0) for a, b in bounds])
        self.ceil = np.stack([low[a:b].max(axis=0) for a, b in bounds])

    def search(self, queries: np.ndarray, low: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(query, row, cosine) of at least the k best per query above its ``bound`` found until the stopping test held, and the share of leaves
        seen."""
        n, leaves = len(queries), len(self.bounds)
        narrow = queries.astype(np.float32)
        gap = np.zeros((n, leaves), np.float32)
        for j in range(low.shape[1]):
            gap += np.maximum(0, np.maximum(self.floor[None, :, j] - low[:, None, j], low[:, None, j] - self.ceil[None, :, j])).astype(np.float32) ** 2
        nearest = np.argsort(gap, axis=1, kind="stable").astype(np.int32)
        gap = np.take_along_axis(gap, nearest, axis=1)
        best = np.repeat(bound.astype(np.float32)[:, None], k, axis=1)
        index = np.full((n, k), -1, np.int64)
        live, done, step, seen = np.arange(n), 0, 1, 0
        while len(live) and done < leaves:
            ahead = min(step, leaves - done)
            who = np.repeat(live, ahead)
            leaf = nearest[live, done : done + ahead].ravel()
            seen += len(who)
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for group in np.split(by, cuts):
                a, b = self.bounds[leaf[group[0]]]
                ask = who[group]
                score = narrow[ask] @ self.rows[a:b].T
                r, c = np.nonzero(score > best[ask, -1][:, None])
                got.append((ask[r], c + a, score[r, c]))
            ask, row, score = (np.concatenate([*x, y]) for x, y in zip(zip(*got, strict=True), (np.repeat(live, k), index[live].ravel(), best[live].ravel()), strict=True))
            by = np.lexsort((row, -score, ask))
            ask, row, score = ask[by], row[by], score[by]
            first = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]])
            rank = np.arange(len(ask)) - np.repeat(first, np.diff(np.r_[first, len(ask)]))
            keep = rank < k
            best[ask[keep], rank[keep]], index[ask[keep], rank[keep]] = score[keep], row[keep]
            done += ahead
            step = min(2 * step, 64)
            if done < leaves:
                kth = np.where(best[live, -1] <= -2, np.inf, 2 - 2 * best[live, -1])
                live = live[gap[live, done] < stop * kth]
        ask, rank = np.nonzero(index >= 0)
        row = index[ask, rank]
        exact = np.einsum("ij,ij->i", queries[ask], self.rows[row].astype(np.float64))
        return ask, self.order[row], exact, seen / max(1, n * leaves)

    def nearest(self, queries: np.ndarray, low: np.ndarray, bound: np.ndarray, own: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) with at least the k best rows above ``bound`` other than ``own`` per query, ties by row.

        The search keeps some rows more than asked. Where the last of these ties with the k-th, rows as good may have been left out: such
        queries scan the whole block.
        """
        places = 2 * k + 2
        ask, row, cosine, _ = self.search(queries, low, bound, places, stop)
        kept = np.bincount(ask, minlength=len(queries))
        rank = np.arange(len(ask)) - np.repeat(np.cumsum(kept) - kept, kept)
        every, other = (np.full((len(queries), places), -np.inf) for _ in range(2))
        every[ask, rank] = cosine
        other[ask, rank] = np.where(row == own[ask], -np.inf, cosine)
        redo = np.flatnonzero(every.min(axis=1) >= -np.sort(-other, axis=1)[:, k - 1] - TIE)
        redo = redo[kept[redo] == places]
        stay = ~np.isin(ask, redo)
        parts = [(ask[stay], row[stay], cosine[stay])]
        for a in range(0, len(redo), SCANNED):
            for q, score in zip(redo[a : a + SCANNED], queries[redo[a : a + SCANNED]].astype(np.float32) @ self.rows.T, strict=True):
                score[self.order == own[q]] = -np.inf
                at = np.flatnonzero(score >= np.partition(score, -k)[-k] - TIE)
                exact = np.einsum("j,ij->i", queries[q], self.rows[at].astype(np.float64))
                best = np.lexsort((self.order[at], -exact))[:k]
                parts.append((np.full(len(best), q), self.order[at[best]], exact[best]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Cells:
    """The upper levels of the tree: splits of the sample at the median of the widest projection until ``wanted`` cells are made, and the
    number of blocks of each cell, more than one where many rows fall together."""

    def __init__(self, low: np.ndarray, wanted: int, n_rows: int, block: int) -> None:
        self.split: list[tuple[int, float, int, int] | int] = []
        floors, ceils, sizes = [], [], []
        inf = np.full(low.shape[1], np.inf)
        todo = [(np.arange(len(low)), -inf, inf, wanted, -1, 0)]
        while todo:
            rows, floor, ceil, parts, parent, side = todo.pop()
            if parent >= 0:
                self.split[parent][2 + side] = len(self.split)
            spread = np.ptp(low[rows], axis=0) if len(rows) > 1 else np.zeros(low.shape[1])
            axis = int(spread.argmax())
            if parts < 2 or spread[axis] == 0:
                self.split.append([-1, 0.0, len(floors), -1])
                floors.append(floor), ceils.append(ceil), sizes.append(len(rows))
                continue
            values = low[rows, axis]
            at = float(np.quantile(values, (parts // 2) / parts))
            at = at if (values < at).any() else float(values[values > at].min())
            here = len(self.split)
            self.split.append([axis, at, -1, -1])
            upper, lower = floor.copy(), ceil.copy()
            upper[axis] = lower[axis] = at
            todo += [(rows[values >= at], upper, ceil, parts - parts // 2, here, 1), (rows[values < at], floor, lower, parts // 2, here, 0)]
        self.floor, self.ceil = np.stack(floors), np.stack(ceils)
        share = np.array(sizes) / len(low)
        self.blocks = np.maximum(1, np.ceil(share * n_rows / (1.5 * block))).astype(np.int64)
        self.first = np.cumsum(self.blocks) - self.blocks

    def of(self, low: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        out = np.zeros(len(low), np.int64)
        todo = [(0, np.arange(len(low)))]
        while todo:
            node, rows = todo.pop()
            axis, at, left, right = self.split[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                below = low[rows, axis] < at
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def reached(self, low: np.ndarray, kth: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells whose projected distance from a query does not end it; its own cell is always among them."""
        gap = np.zeros((len(low), len(self.floor)))
        for j in range(low.shape[1]):
            gap += np.maximum(0, np.maximum(self.floor[None, :, j] - low[:, None, j], low[:, None, j] - self.ceil[None, :, j])) ** 2
        return np.nonzero((gap == 0) | (gap < stop * kth[:, None]))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, projections: int = PROJECTIONS, leaf: int = LEAF, miss: float = MISS, block: int = BLOCK, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(query, near, cosine): for each key of ``queries`` the k other keys of ``vectors`` with the largest cosine, ties by key.

    Repeated rows count once (a key's vectors are taken to be equal). Null keys and null, empty, all-zero, non-finite or wrongly sized
    vectors take no part, as query or as neighbour; the size is that of most of the sample, the ``sample`` rows with the smallest hashes
    of their keys. Fewer than k rows come out where fewer others exist.
    """
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("query", key_type), T.StructField("near", key_type), T.StructField("cosine", T.DoubleType())])
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    picked = rows.select("key", "vector", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(sample).select("key", "vector").toArrow()
    sizes = np.asarray(picked["vector"].combine_chunks().value_lengths()) if len(picked) else np.zeros(0, np.int64)
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    at, known = unit_rows(picked["vector"], width)
    if not len(at):
        return spark.createDataFrame([], schema)
    names = picked["key"].take(pa.array(at)).combine_chunks()
    first = np.unique(np.asarray(names.dictionary_encode().indices), return_index=True)[1]
    names, known = names.take(pa.array(first)), known[first]
    axes = np.random.default_rng(seed).standard_normal((width, projections))
    n_rows = rows.count()
    cells = Cells(known @ axes, max(1, -(-n_rows // block)), n_rows, block)
    stop = chi_square_quantile(projections, 1 - miss)
    sent = spark.sparkContext.broadcast((names, known.astype(np.float32), axes, cells))
    placed_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", key_type), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("bound", T.FloatType())])
    wanted = rows.join(queries.select(F.col(key).alias("__q")).distinct(), F.col("key") == F.col("__q"), "left_semi").groupBy("key").agg(F.max("vector").alias("vector"))
    hashed = lambda df: df.select("key", "vector", F.xxhash64("key").alias("h"))
    both = hashed(rows).mapInArrow(_placer(sent), placed_schema).unionByName(hashed(wanted).mapInArrow(_visitor(sent, k, stop), placed_schema))
    met = both.repartitionById(int(cells.blocks.sum()), F.col("block").cast("int")).sortWithinPartitions("block", "kind").mapInArrow(_searcher(sent, k, leaf, stop), schema)
    once = met.groupBy("query", "near").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "near"))
    return once.withColumn("__rank", rank).where(F.col("__rank") <= k).select("query", "near", "cosine")


def _batch(block: np.ndarray, kind: int, key: pa.Array, vector: pa.Array, bound: np.ndarray) -> pa.RecordBatch:
    n = len(block)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.full(n, kind, np.int32)), key, vector.cast(pa.list_(pa.float32())), pa.array(bound.astype(np.float32))], names=["block", "kind", "key", "vector", "bound"])


def _placer(sent):
    """Rows to the block they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, axes, cells = sent.value
        for batch in batches:
            at, rows = unit_rows(batch.column("vector"), known.shape[1])
            if len(at):
                cell = cells.of(rows @ axes)
                pick = pa.array(at)
                block = cells.first[cell] + np.asarray(batch.column("h"))[at] % cells.blocks[cell]
                yield _batch(block, 0, batch.column("key").take(pick), batch.column("vector").take(pick), np.zeros(len(at)))

    return run


def _visitor(sent, k: int, stop: float):
    """Queries to all blocks of the cells they have to see, with the similarity that the k-th neighbour has at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        names, known, axes, cells = sent.value
        for batch in batches:
            at, rows = unit_rows(batch.column("vector"), known.shape[1])
            for a in range(0, len(at), 1024):
                part, use = rows[a : a + 1024], at[a : a + 1024]
                key = batch.column("key").take(pa.array(use))
                score = part.astype(np.float32) @ known.T
                own = np.asarray(pa.compute.index_in(key, value_set=names).fill_null(-1))
                score[np.flatnonzero(own >= 0), own[own >= 0]] = -2
                bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(part), -2.0)
                query, cell = cells.reached(part @ axes, np.where(bound <= -2, np.inf, 2 - 2 * bound), stop)
                times = cells.blocks[cell]
                query, block = np.repeat(query, times), np.repeat(cells.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                for b in range(0, len(query), 8192):
                    few = slice(b, b + 8192)
                    pick = pa.array(use[query[few]])
                    yield _batch(block[few], 1, batch.column("key").take(pick), batch.column("vector").take(pick), np.maximum(bound[query[few]] - 4 * TIE, -2))

    return run


def _searcher(sent, k: int, leaf: int, stop: float):
    """In every block the rows, which come first, become a tree, and the queries search it."""

    def build(keys: list[pa.Array], rows: list[np.ndarray], axes: np.ndarray) -> tuple[pa.Array, Tree]:
        key = pa.concat_arrays(keys)
        first = np.unique(np.asarray(key.dictionary_encode().indices), return_index=True)[1]
        first = first[np.asarray(pa.compute.sort_indices(key.take(pa.array(first))))]
        return key.take(pa.array(first)), Tree(np.concatenate(rows)[first], axes, leaf)  # one row to a key, in the order of keys

    def answer(part: pa.RecordBatch, key: pa.Array, tree: Tree, axes: np.ndarray) -> pa.RecordBatch:
        at, queries = unit_rows(part.column("vector"), len(axes))
        names = part.column("key").take(pa.array(at))
        own = np.asarray(pa.compute.index_in(names, value_set=key).fill_null(-1))
        ask, row, cosine = tree.nearest(queries, queries @ axes, np.asarray(part.column("bound"))[at], own, k, stop)
        query, near = names.take(pa.array(ask)), key.take(pa.array(row))
        return pa.RecordBatch.from_arrays([query, near, pa.array(cosine)], names=["query", "near", "cosine"]).filter(pa.compute.not_equal(query, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        axes = sent.value[2]
        block, keys, rows, made = None, [], [], None
        for batch in batches:
            at, kind = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at[a] != block:
                    block, keys, rows, made = at[a], [], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    keys.append(part.column("key"))
                    rows.append(unit_rows(part.column("vector"), len(axes))[1].astype(np.float32))
                elif keys:
                    made = made or build(keys, rows, axes)
                    for c in range(0, len(part), TOGETHER):
                        yield answer(part.slice(c, TOGETHER), *made, axes)

    return run


def found(probes: DataFrame, encoders: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(encoder, path, near_path): the k most similar other photos of each probe photo under each encoder."""
    parts = [nearest(vectors, probes, "path", "img_emb", k).select(F.lit(name).alias("encoder"), F.col("query").alias("path"), F.col("near").alias("near_path")) for name, vectors in encoders.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

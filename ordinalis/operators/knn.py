"""Out-of-fold nearest neighbours by cosine and the target features made from them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.session import cut

#: Queries sent to the executors at once; more queries take further passes over the reference rows.
CHUNK = 32_768


def _matrix(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    good = np.array([v is not None and len(v) == width for v in column], bool)
    rows = np.zeros((len(column), width))
    if good.any():
        rows[good] = np.stack(column[good].to_list())
    norm = np.sqrt((rows * rows).sum(axis=1))
    good &= np.isfinite(norm) & (norm > 0)
    rows[~good] = 0
    return rows / np.where(good, norm, 1.0)[:, None], good


def knn_join(queries: DataFrame, reference: DataFrame, k: int, *, chunk: int = CHUNK) -> DataFrame:
    """(q, r, y, sim, rank): the k reference rows most similar to each query, of another fold where both have one.

    ``queries`` has q, vec, fold; ``reference`` has r, vec, fold, y. Similarities are rounded to 9 digits before ranking and ties go to
    the smaller r, so the result does not depend on the order of additions. Vectors that are null, empty, all zero, not finite or of
    another size take no part. The reference side is scanned in place: per batch one matrix product and a local top k, so k rows per
    query and batch are shuffled instead of all pairs.
    """
    spark = queries.sparkSession
    rows = queries.where("q is not null and vec is not null").select("q", "vec", "fold")
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").collect()  # a handful of sizes
    width = sizes[0]["size"] if sizes else 0
    passes = max(1, -(-sum(s["count"] for s in sizes) // chunk))
    q_type, r_type, y_type = queries.schema["q"].dataType.simpleString(), reference.schema["r"].dataType.simpleString(), reference.schema["y"].dataType.simpleString()
    schema = f"q {q_type}, r {r_type}, y {y_type}, sim double"
    whole = None
    for p in range(passes):
        table = rows.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).toPandas()
        if not len(table):
            continue
        asked, good = _matrix(table["vec"], width)
        names, folds = table["q"].to_numpy()[good], table["fold"].to_numpy(float)[good]
        sent = spark.sparkContext.broadcast((names, folds, asked[good], width))
        part = _ranked(reference.where("r is not null and vec is not null").select("r", "vec", "fold", "y").mapInPandas(_best_of(sent, k), schema), k)
        if passes > 1:  # written before the next pass, so one chunk of queries is held at a time
            part = cut(part)
            sent.destroy()
        whole = part if whole is None else whole.unionByName(part)
    return _ranked(spark.createDataFrame([], schema), k) if whole is None else whole


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "r"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(sent, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, folds, asked, width = sent.value
        single, least = asked.astype(np.float32), np.full(len(asked), -np.inf)
        best = np.full((len(asked), k), -np.inf)
        for batch in batches:
            rows, good = _matrix(batch["vec"], width)
            batch, rows = batch[good].sort_values("r"), rows[good][np.argsort(batch["r"][good].to_numpy(), kind="stable")]
            if not len(batch):
                continue
            fold, columns = batch["fold"].to_numpy(float), rows.T.astype(np.float32)
            for a in range(0, len(asked), 512):
                part = slice(a, a + 512)
                sim = single[part] @ columns  # no more than ERROR off, so whatever may be among the first k is computed in full
                sim[folds[part, None] == fold[None, :]] = -np.inf
                bound = least[part] - ERROR
                if len(batch) > k and not np.isfinite(bound).all():
                    bound = np.maximum(bound, np.partition(sim, len(batch) - k, axis=1)[:, -k] - 2 * ERROR)
                i, j = np.nonzero((sim >= bound[:, None]) & (sim > -np.inf))
                exact = np.round(np.einsum("ij,ij->i", asked[a + i], rows[j]), 9)
                order = np.lexsort((j, -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                keep = (place < k) & (exact >= least[a + i])
                i, j, exact, place = i[keep], j[keep], exact[keep], place[keep]
                found = np.full((len(bound), k), -np.inf)
                found[i, place] = exact
                best[part] = -np.sort(-np.concatenate([best[part], found], axis=1), axis=1)[:, :k]
                least[part] = best[part, k - 1]
                yield pd.DataFrame({"q": names[a + i], "r": batch["r"].to_numpy()[j], "y": batch["y"].to_numpy()[j], "sim": exact})

    return run


def knn_target(neighbours: DataFrame, queries: DataFrame, power: float = 4.0, valid: str = "valid", k: int | None = None) -> DataFrame:
    """(q, knn_y, nn1_y, nn1_sim, knn_mean_sim): similarity-weighted target of the neighbours, the nearest one's target, the largest
    and the mean similarity, clipped to [0, 1]. The two targets are null for queries that are not ``valid``; all are null without
    neighbours. With ``k``, neighbours that are missing count as k of similarity 0 and unknown target."""
    s = F.greatest(F.least(F.col("sim"), F.lit(1.0)), F.lit(0.0))
    weight = F.pow(s, F.lit(power))
    mean = F.avg(s) if k is None else F.sum(s) / k
    features = neighbours.groupBy("q").agg((F.sum(weight * F.col("y")) / (F.sum(weight) + 1e-9)).alias("knn_y"), F.min_by("y", "rank").cast("double").alias("nn1_y"), F.max(s).alias("nn1_sim"), mean.alias("knn_mean_sim"))
    joined = queries.select("q", valid).join(features, "q", "left")
    if k is not None:
        joined = joined.na.fill(0.0, ["knn_y", "nn1_sim", "knn_mean_sim"])
    return joined.select("q", F.when(F.col(valid), F.col("knn_y")).alias("knn_y"), F.when(F.col(valid), F.col("nn1_y")).alias("nn1_y"), "nn1_sim", "knn_mean_sim")


#: Rarest terms of a query that give its first candidates.
SEEDS = 8


def sparse_knn_join(postings: DataFrame, docs: DataFrame, key: str, k: int, *, seeds: int = SEEDS) -> DataFrame:
    """(q, r, y, sim, rank): the k reference documents most similar to each document, of another fold where both have one; exact.

    ``postings`` has key, term, df, weight with documents of length one; ``docs`` has key, fold, y, and is a reference where y is not null
    and valid. Only similarities above 0 count, rounded to 9 digits, ties by the smaller key.

    Candidates by a document's rarest terms give a lower bound of its k-th similarity. A reference that shares no term of its prefix,
    the rarest terms up to where the rest of the document is shorter than that bound, cannot reach it; so only prefixes are joined with
    the postings, and the most frequent terms, which would pair all with all, seldom take part.
    """
    order = W.partitionBy(key).orderBy("df", "term")
    before = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(W.unboundedPreceding, -1))
    ranked = cut(postings.select(F.col(key).alias("q"), "term", "weight", F.row_number().over(order).alias("place"), F.sqrt(F.greatest(1.0 - F.coalesce(before, F.lit(0.0)), F.lit(0.0))).alias("rest")))
    asked = docs.select(F.col(key).alias("q"), F.col("fold").alias("qf"))
    known = docs.where("y is not null and valid").select(F.col(key).alias("r"), F.col("fold").alias("rf"), "y")
    held = cut(ranked.select(F.col("q").alias("r"), "term").join(known, "r"))
    packed = F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("h"), "weight")))
    vectors = cut(ranked.groupBy("q").agg(packed.alias("p")).select("q", F.col("p.h").alias("h"), F.col("p.weight").alias("w")))
    types = {c: postings.schema[key].dataType.simpleString() for c in ("q", "r")} | {"y": docs.schema["y"].dataType.simpleString()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sims = []
            for ha, wa, hb, wb in zip(batch["ha"], batch["wa"], batch["hb"], batch["wb"], strict=True):
                _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                sims.append(round(float(np.dot(np.asarray(wa)[i], np.asarray(wb)[j])), 9))
            yield batch[["q", "r", "y"]].assign(sim=sims)

    def best(prefix: DataFrame) -> DataFrame:
        met = prefix.join(asked, "q").join(held, "term").where((F.col("q") != F.col("r")) & ~F.coalesce(F.col("qf") == F.col("rf"), F.lit(False))).select("q", "r", "y").distinct()
        left = vectors.select("q", F.col("h").alias("ha"), F.col("w").alias("wa"))
        right = vectors.select(F.col("q").alias("r"), F.col("h").alias("hb"), F.col("w").alias("wb"))
        both = met.join(left.hint("merge"), "q").join(right.hint("merge"), "r")
        scored = both.select("q", "r", "y", "ha", "wa", "hb", "wb").mapInPandas(score, f"q {types['q']}, r {types['r']}, y {types['y']}, sim double")
        return _ranked(scored.where("sim > 0"), k)

    first = best(ranked.where(F.col("place") <= seeds))
    bound = cut(first.groupBy("q").agg(F.min("sim").alias("least"), F.count("*").alias("n"))).where(F.col("n") >= k)
    prefix = ranked.join(bound.hint("merge"), "q", "left").where(F.col("rest") >= F.coalesce(F.col("least"), F.lit(0.0)) - 1e-6)
    return best(prefix.select("q", "term"))


#: Documents and postings that a block of packed documents holds at most, and blocks of references that a task reads one after another.
BLOCK, POSTINGS, RUN = 3_000, 3_000_000, 6
#: Most frequent terms that are multiplied as a dense matrix, and the part of the documents from which a term is one of them.
DENSE, SHARE = 4_096, 0.03
#: Queries that are held against a block of references at once, and what single precision may be off by.
TILE, ERROR = 128, 1e-5


def dense_from(df: np.ndarray, n_docs: int) -> int:
    """The number from which terms are frequent, of a vocabulary in order of document frequency."""
    return max(int(np.searchsorted(df, SHARE * n_docs)), len(df) - DENSE)


def _blocks(rows: DataFrame) -> DataFrame:
    """(no, data): the documents (key, i, w) of every task in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, i, w, held, made = [], [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            data = pickle.dumps((keys, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(i), np.concatenate(w)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), pa.array([data], pa.binary())], ["no", "data"])

        for batch in batches:
            for key, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                keys.append(tuple(key.values()))
                i.append(a.values.to_numpy())
                w.append(b.values.to_numpy())
                sizes.append(len(i[-1]))
                held += sizes[-1]
                if len(keys) >= BLOCK or held >= POSTINGS:
                    yield block()
                    keys, sizes, i, w, held, made = [], [], [], [], 0, made + 1
        if keys:
            yield block()

    return rows.mapInArrow(run, "no long, data binary")


class _References:
    """The references of a block: their dense part, and the postings of the other terms by term."""

    def __init__(self, data: bytes, n_terms: int, first: int) -> None:
        keys, at, i, w = pickle.loads(data)
        known = [j for j, (_, _, y, valid) in enumerate(keys) if y is not None and valid]
        self.names, self.y = [keys[j][0] for j in known], [keys[j][2] for j in known]
        self.fold = np.array([keys[j][1] for j in known], float)
        self.parts = [(i[at[j] : at[j + 1]], w[at[j] : at[j + 1]]) for j in known]
        row = np.repeat(np.arange(len(known)), [len(x) for x, _ in self.parts])
        terms, weights = (np.concatenate([p[c] for p in self.parts]) if known else np.zeros(0, (np.int32, float)[c]) for c in (0, 1))
        often = terms >= first
        self.dense = np.zeros((len(known), n_terms - first), np.float32)
        self.dense[row[often], terms[often] - first] = weights[often]
        row, terms, weights = row[~often], terms[~often], weights[~often]
        order = np.argsort(terms, kind="stable")
        self.row, self.weight, self.df = row[order], weights[order], np.bincount(terms, minlength=first)
        self.start = np.cumsum(self.df) - self.df

    def near(self, row: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, first: int) -> np.ndarray:
        """The similarities of ``n`` queries to every reference, in single precision."""
        often = terms >= first
        asked = np.zeros((n, self.dense.shape[1]), np.float32)
        asked[row[often], terms[often] - first] = weights[often]
        sim = asked @ self.dense.T
        here = np.flatnonzero(~often)
        here = here[self.df[terms[here]] > 0]
        many = self.df[terms[here]]
        total = np.cumsum(many)
        for a, b in _pieces(total):
            size, k = many[a:b], here[a:b]
            place = np.arange(size.sum()) + np.repeat(self.start[terms[k]] - np.cumsum(size) + size, size)
            sim += np.bincount(np.repeat(row[k] * sim.shape[1], size) + self.row[place], np.repeat(weights[k], size) * self.weight[place], sim.size).reshape(sim.shape)
        return sim


def _pieces(total: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a running sum that each add up to about ``most``."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _first(found: list[tuple], k: int) -> list[tuple]:
    """Of (query, reference, y, sim) the ``k`` nearest of every query."""
    out, n, last = [], 0, None
    for x in sorted(found, key=lambda x: (x[0], -x[3], x[1])):
        n, last = (n + 1 if x[0] == last else 0), x[0]
        if n < k:
            out.append(x)
    return out


def packed_knn_join(rows: DataFrame, key: str, n_terms: int, first: int, k: int) -> DataFrame:
    """(q, r, y, sim, rank) as of ``sparse_knn_join``, of packed documents: ``key`` is a struct of id, fold, y and valid in this order, i and w are the
    numbers and weights of the terms, numbered by rising frequency. Terms from ``first`` on are frequent.

    Every block of queries meets every block of references where both lie in the checkpoint folder, so no posting is shuffled. All
    similarities of two blocks are made in single precision, frequent terms by a dense product and the others by their postings; what
    comes within the error of a query's k-th is computed in full.
    """
    name, _, y_type, _ = (f.dataType.simpleString() for f in rows.schema[key].dataType.fields)
    blocks = cut(_blocks(rows.select(key, "i", "w")))
    left, right = blocks.toDF("no", "a"), blocks.select(F.col("data").alias("b")).coalesce(max(1, -(-blocks.count() // RUN)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, keys, found, flat = None, [], [], np.zeros(n_terms)
        give = lambda: pd.DataFrame([(keys[q][0], *x) for q, *x in found], columns=["q", "r", "y", "sim"])
        for batch in batches:
            for no, a, b in batch.itertuples(index=False):
                if no != number:
                    yield give()
                    number, found = no, []
                    keys, at, i, w = pickle.loads(a)
                    folds, least = np.array([x[1] for x in keys], float), np.zeros(len(keys))
                known = _References(b, n_terms, first)
                if not known.names:
                    continue
                own = {r: j for j, r in enumerate(known.names)}
                for s in range(0, len(keys), TILE):
                    e = min(s + TILE, len(keys))
                    part = slice(at[s], at[e])
                    sim = known.near(np.repeat(np.arange(e - s), np.diff(at[s : e + 1])), i[part], w[part], e - s, first)
                    sim[folds[s:e, None] == known.fold[None, :]] = 0
                    for q in range(s, e):
                        if (j := own.get(keys[q][0])) is not None:
                            sim[q - s, j] = 0
                    top = np.partition(sim, len(known.names) - k, axis=1)[:, -k] if len(known.names) > k else np.zeros(e - s)
                    ask, ref = np.nonzero((sim > 0) & (sim >= np.maximum(top - 2 * ERROR, least[s:e] - ERROR)[:, None]))
                    for q, j in zip(*np.unique(ask, return_index=True)):
                        mine = slice(at[s + q], at[s + q + 1])
                        flat[i[mine]] = w[mine]
                        for r in ref[j : j + np.searchsorted(ask[j:], q, side="right")]:
                            terms, weights = known.parts[r]
                            if (exact := round(float(flat[terms] @ weights), 9)) > 0:
                                found.append((s + int(q), known.names[r], known.y[r], exact))
                        flat[i[mine]] = 0
                found = _first(found, k)
                for n in range(k - 1, len(found)):
                    if found[n - k + 1][0] == found[n][0]:
                        least[found[n][0]] = found[n][3]
        yield give()

    both = left.join(right.hint("shuffle_replicate_nl"))
    return _ranked(both.select("no", "a", "b").mapInPandas(run, f"q {name}, r {name}, y {y_type}, sim double"), k)

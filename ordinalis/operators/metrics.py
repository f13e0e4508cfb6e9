"""Agreement, error, rank and drift metrics, each as one aggregation; and the cut-points that turn scores into labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.session import cut


def qwk(y: Column | str, p: Column | str) -> Column:
    """Quadratic weighted kappa: 2 cov / (var y + var p + (mean y - mean p)^2); null where both sides are one constant."""
    bottom = F.var_pop(y) + F.var_pop(p) + F.pow(F.avg(y) - F.avg(p), F.lit(2))
    constant = (F.min(y) == F.max(y)) & (F.min(p) == F.max(p)) & (F.min(y) == F.min(p))  # merged variances may miss zero by a rounding
    return F.when(~constant, 2 * F.covar_pop(y, p) / F.nullif(bottom, F.lit(0.0)))


def rmse(a: Column | str, b: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.sqrt(F.avg(F.pow(c(a) - c(b), F.lit(2))))


def agreement(a: str, b: str) -> Column:
    return F.avg((F.col(a) == F.col(b)).cast("double"))


def running_counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, column, n, below): every distinct value with its rows and the rows of smaller values; nulls do not count.

    The values are counted first; the running sum goes over ranges of the values and inside ranges, so no task ever sorts a whole column.
    Which range a value is in is written down once, as two readings of one plan may cut the ranges differently.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    ranges = cut(counts.repartitionByRange(*by, column).withColumn("__part", F.spark_partition_id()))
    totals = ranges.groupBy(*by, "__part").agg(F.sum("n").alias("__t"))
    bases = totals.select(*(F.col(c).alias(f"__b{k}") for k, c in enumerate(by)), F.col("__part").alias("__p"), (F.sum("__t").over(W.partitionBy(*by).orderBy("__part")) - F.col("__t")).alias("__base"))
    inside = F.sum("n").over(W.partitionBy(*by, "__part").orderBy(column)) - F.col("n")
    match = F.col("__part") == F.col("__p")
    for k, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__b{k}"))
    return ranges.withColumn("__below", inside).join(bases, match).select(*by, column, "n", (F.col("__base") + F.col("__below")).alias("below"))


def average_ranks(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the average rank of ``column``, ties sharing their mean; null values rank null."""
    by = by or []
    ranked = running_counts(df, column, by).select(*by, column, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranked, [*by, column], "left")


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles with linear interpolation, picked by position from the running counts."""
    counts = running_counts(df, column, by)
    totals = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("__all"))
    placed = counts.join(totals, by)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    low = [F.floor((F.col("__all") - 1) * q) for q in shares]
    picks = [F.max(F.when(holds(place), F.col(column).cast("double"))).alias(f"__{side}{k}") for k, at in enumerate(low) for side, place in (("l", at), ("h", F.least(at + 1, F.col("__all") - 1)))]
    picked = placed.groupBy(*by, "__all").agg(*picks)
    part = [(F.col("__all") - 1) * q - F.floor((F.col("__all") - 1) * q) for q in shares]
    return picked.select(*by, F.col("__all").alias("n"), *((F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * p).alias(f"q{k}") for k, p in enumerate(part)))


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, rho) per column, nulls counting as -1."""
    stacked = df.select(F.col(target).cast("double").alias("__y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias("v")) for c in columns))).alias("x")).select("__y", "x.feature", "x.v")
    ranked = average_ranks(average_ranks(stacked, "v", "rv", ["feature"]), "__y", "ry", ["feature"])
    return ranked.groupBy("feature").agg(F.corr("rv", "ry").alias("rho"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): area under the ROC curve by ranks, ties by average rank; null with one class only. ``label`` is 0 or 1."""
    ranked = average_ranks(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("l"), F.col(score).alias("s")), "s", "r")
    pos, n = F.sum("l").cast("double"), F.count("*").cast("double")
    return ranked.agg(((F.sum(F.col("r") * F.col("l")) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("auc"))


def confusion(df: DataFrame, y: str, p: str, labels: list[int]) -> DataFrame:
    """(y, p, n, share): the dense grid of labels with counts and row shares; pairs with a null or unknown label do not count."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y int, p int")
    counts = df.groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count("*").alias("n"))
    dense = grid.join(counts, ["y", "p"], "left")
    filled = dense.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return filled.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("y")), F.lit(0)))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def drift(df: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """(feature, train_mean, test_mean, diff_pct): relative difference of the test mean in percent of the train mean's size."""
    means = df.agg(*(F.avg(F.when(F.col(split) == s, F.col(c).cast("double"))).alias(f"{c}__{s}") for c in columns for s in ("train", "test")))
    rows = means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}__train").alias("train_mean"), F.col(f"{c}__test").alias("test_mean")) for c in columns))).alias("x")).select("x.*")
    return rows.withColumn("diff_pct", 100 * (F.col("test_mean") - F.col("train_mean")) / F.nullif(F.abs("train_mean"), F.lit(0.0)))


def apply_cuts(score: Column, cuts: list[float], labels: list[int] | None = None) -> Column:
    """The label of the interval a score falls into; an interval holds its lower end. Null stays null."""
    cuts = sorted(cuts)
    labels = labels or list(range(1, len(cuts) + 2))
    out = F.lit(labels[0])
    for c, label in zip(cuts, labels[1:], strict=True):
        out = F.when(score >= c, F.lit(label)).otherwise(out)
    return F.when(score.isNotNull(), out)


def round_labels(score: Column, low: int, high: int) -> Column:
    """Half-even rounding clipped to the label range."""
    return F.least(F.greatest(F.bround(score, 0).cast("int"), F.lit(low)), F.lit(high))


def optimise_cuts(df: DataFrame, score: str, y: str, labels: tuple[int, ...] = (1, 2, 3, 4), bins: int = 2000, rounds: int = 30) -> list[float]:
    """Cut-points that maximise the kappa, by coordinate search over prefix counts of ``bins`` score bins.

    The bins hold about equally many rows (approximate quantiles), so an outlier does not coarsen them. Only the table of bins and labels
    reaches the driver, so the search costs the same at any number of rows. Constant or empty scores give the midpoints between labels.
    """
    start = [(a + b) / 2 for a, b in zip(labels, labels[1:], strict=False)]
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isin(*labels)).select(F.col(score).cast("double").alias("s"), F.col(y).cast("int").alias("y"))
    low, high, inner = rows.agg(F.min("s"), F.max("s"), F.percentile_approx("s", F.array(*(F.lit(k / bins) for k in range(1, bins))), 20 * bins)).first()
    if low is None or low == high:
        return start
    edges = np.unique(np.array([*inner, *start]))  # a bin begins at each edge
    binned = Bucketizer(splits=[-math.inf, *edges.tolist(), math.inf], inputCol="s", outputCol="b").transform(rows)
    counts = np.zeros((len(edges) + 1, len(labels)))
    for b, label, n in binned.groupBy(F.col("b").cast("int").alias("b"), "y").count().collect():
        counts[b, labels.index(label)] += n
    number = np.concatenate([[0.0], counts.sum(axis=1).cumsum()])
    total = np.concatenate([[0.0], (counts @ np.arange(len(labels))).cumsum()])
    n, y_mean = number[-1], total[-1] / number[-1]
    y_var = (counts.sum(axis=0) * (np.arange(len(labels)) - y_mean) ** 2).sum() / n

    def values(marks: np.ndarray) -> np.ndarray:
        """The kappa of every row of cuts."""
        whole = np.column_stack([np.zeros(len(marks), int), np.sort(marks, axis=1), np.full(len(marks), len(edges) + 1)])
        size, y_sum, p = np.diff(number[whole], axis=1), np.diff(total[whole], axis=1), np.arange(len(labels))
        p_mean = size @ p / n
        bottom = y_var + size @ (p * p) / n - p_mean**2 + (y_mean - p_mean) ** 2
        return np.divide(2 * (y_sum @ p / n - y_mean * p_mean), bottom, out=np.zeros(len(marks)), where=bottom > 0)

    def climb(at: np.ndarray) -> tuple[float, np.ndarray]:
        best = values(at[None, :])[0]
        for _ in range(rounds):
            before = best
            for k in range(len(at)):
                tried = np.arange(at[k - 1] if k else 1, (at[k + 1] if k + 1 < len(at) else len(edges)) + 1)
                marks = np.repeat(at[None, :], len(tried), axis=0)
                marks[:, k] = tried
                found = values(marks)
                if found.max() > best + 1e-12:
                    at, best = marks[found.argmax()], found.max()
            if best <= before:
                break
        return best, at

    # A cut lies before bin at[k]. Beside the midpoints, the cuts that give each label its own share are a start.
    shares = np.clip(np.searchsorted(number[1:], counts.sum(axis=0).cumsum()[:-1]) + 1, 1, len(edges))
    first, second = climb(np.searchsorted(edges, start) + 1), climb(shares)
    return [float(edges[a - 1]) for a in (second if second[0] > first[0] + 1e-12 else first)[1]]

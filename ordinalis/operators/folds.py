"""Deterministic stratified folds and samples by hashed order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_key(seed: int, key: str) -> Column:
    """A hexadecimal key whose order is random but the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def hashed_rank(df: DataFrame, by: list[str], key: str, seed: int, out: str) -> DataFrame:
    """``df`` with the 1-based rank of each row by ``hash_key`` within ``by``.

    The first three hexadecimal digits of the hash cut every class into 4,096 ranges; ranks are taken inside a range and shifted by
    the counts of the ranges before, so a class of any size is spread over all tasks.
    """
    hashed = df.withColumn("__h", hash_key(seed, key)).withColumn("__r", F.substring("__h", 1, 3))
    counts = hashed.groupBy(*by, "__r").agg(F.count("*").alias("__n"))
    base = counts.select(*(F.col(b).alias(f"__b{k}") for k, b in enumerate(by)), F.col("__r").alias("__rr"), (F.sum("__n").over(W.partitionBy(*by).orderBy("__r")) - F.col("__n")).alias("__base"))
    inside = F.row_number().over(W.partitionBy(*by, "__r").orderBy("__h", key))
    match = F.col("__r") == F.col("__rr")
    for k, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"__b{k}"))
    return hashed.withColumn("__i", inside).join(base, match).withColumn(out, (F.col("__base") + F.col("__i")).cast("long")).select(*df.columns, out)


def stratified_folds(df: DataFrame, label: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with a fold 0..n-1; the counts of a label in any two folds differ by at most one. A null label is a class of its own."""
    return hashed_rank(df, [label], key, seed, "__rank").withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(n)).cast("int")).drop("__rank")


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of every class, the same at every run."""
    return hashed_rank(df, [label], key, seed, "__rank").where(F.col("__rank") <= n).drop("__rank")


def subsamples(df: DataFrame, key: str, draws: int, n: int, seed: int) -> DataFrame:
    """``df`` times ``draws`` with a draw number: every draw holds ``n`` rows without replacement."""
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__k", F.concat("draw", F.lit(":"), F.col(key).cast("string")))
    return hashed_rank(many, ["draw"], "__k", seed, "__rank").where(F.col("__rank") <= n).drop("__rank", "__k")


def subsample_kappas(cells: DataFrame, y: str, pred: str, draws: int, sizes: tuple[int, ...], seed: int) -> DataFrame:
    """(n, draw, kappa) of ``draws`` subsets of each size without replacement. ``cells`` has ``y``, ``pred`` and n: how often they meet.

    The kappa of a subset rests on these counts alone, and the counts of a subset are a multivariate hypergeometric draw from them; so
    the cost does not depend on the number of rows. A size beyond the rows takes all of them; kappa is null where it is not defined.
    """
    table = cells.select(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("p"), "n").toPandas()  # a handful
    gap = (table["y"] - table["p"]).to_numpy(float) ** 2
    count = table["n"].to_numpy(np.int64)
    levels = [table[c].to_numpy() for c in ("y", "p")]
    labels = np.unique(np.concatenate(levels))
    sides = [(labels[:, None] == level[None, :]).astype(float) for level in levels]
    apart = (labels[:, None] - labels[None, :]).astype(float) ** 2

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number in batch["id"]:
                size, k = divmod(int(number), draws)
                n = min(sizes[size], int(count.sum()))
                got = np.random.default_rng([seed, size, k]).multivariate_hypergeometric(count, n, method="marginals")
                chance = (sides[0] @ got) @ apart @ (sides[1] @ got) / max(n, 1)
                out.append((n, k, 1 - float(gap @ got) / chance if chance else None))
            yield pd.DataFrame(out, columns=["n", "draw", "kappa"])

    return cells.sparkSession.range(draws * len(sizes)).mapInPandas(draw, "n long, draw int, kappa double")

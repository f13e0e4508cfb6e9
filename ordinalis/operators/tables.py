"""Relational summaries: counts, bins, cross tables, group spread, overlaps between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.operators import metrics
from ordinalis.session import cut


def add_child_count(parents: DataFrame, children: DataFrame, key: str, out: str = "n_photos") -> DataFrame:
    """Left join of the number of children; parents without any get 0. The children are counted before they are shuffled."""
    counts = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """'(a, b]' of the interval that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((value > a) & (value <= b), F.lit(f"({a:g}, {b:g}]")).otherwise(out)
    return out


def cross_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) with margins: a null on one side stands for all, cells without rows are missing."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).cube(row, column).agg(F.count("*").alias("n"))


def spread_in_groups(df: DataFrame, group: str, y: str) -> DataFrame:
    """(n_multi, mean_group_std, global_std): sample deviation inside groups averaged over groups, beside the population deviation. Both
    sides of the keyless join are one row."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.stddev_samp(y).alias("s"))
    inside = per.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_multi"), F.avg("s").alias("mean_group_std"))
    return inside.join(df.agg(F.stddev_pop(y).alias("global_std")))


def members_of_largest(df: DataFrame, group: str) -> DataFrame:
    top = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(1).select(group)
    return df.join(F.broadcast(top), group, "left_semi")  # one row


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bin, n): equal bins on [low, high], values outside clipped into the outer bins, the last bin holding its upper end."""
    v = F.least(F.greatest(F.col(column).cast("double"), F.lit(low)), F.lit(high))
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(*by, number.alias("bin")).agg(F.count("*").alias("n"))


def stacked(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep, feature, v): one row per value of ``columns`` that is not null, as a double."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns)))
    return df.select(*keep, values.alias("x")).select(*keep, "x.*").where("v is not null")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, median, q999, max); quantiles are exact, with linear interpolation, by running counts of values."""
    rows = stacked(df, columns)
    plain = rows.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return plain.join(metrics.quantiles(rows, "v", [0.5, 0.999], ["feature"]), "feature").select("feature", "n", "mean", "std", "min", F.col("q0").alias("median"), F.col("q1").alias("q999"), "max")


def box_plot(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, feature, n, q1, median, q3, low, high): exact quartiles, and the outermost values within 1.5 quartile distances of them."""
    rows = stacked(df, columns, by)
    quartiles = metrics.quantiles(rows, "v", [0.25, 0.5, 0.75], [by, "feature"]).select(F.col(by).alias("__by"), F.col("feature").alias("__f"), "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    inside = rows.join(quartiles, F.col(by).eqNullSafe(F.col("__by")) & (F.col("feature") == F.col("__f"))).where(F.col("v").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return inside.groupBy(by, "feature", "n", "q1", "median", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def density(df: DataFrame, column: str, by: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n, density): a histogram per group whose area is one, so groups of different size lie over one another."""
    counts = histogram(df, column, low, high, bins, by)
    width = (high - low) / bins
    return counts.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(by)) / F.lit(width))


def strict_lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the table row of the same key, whose keys are unique. A key without a row fails the job where it is met,
    so no pass over the data is spent on looking for misses."""
    found = rows.join(table.select(F.col(table_key).alias("__key"), F.struct(value).alias("__value")), F.col(key) == F.col("__key"), "left")
    miss = F.raise_error(F.concat(F.lit(f"no {table_key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(value, F.when(F.col("__value").isNotNull(), F.col(f"__value.{value}")).otherwise(miss)).drop("__key", "__value")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its 0-based position in the order of ``order``, which must tell the rows apart: by ranges, not in one task."""
    ranges = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranges.groupBy("__part").agg(F.count("*").alias("__n"))
    bases = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__base"))  # one row a range
    placed = ranges.withColumn("__i", F.row_number().over(W.partitionBy("__part").orderBy(*order))).join(bases, F.col("__part") == F.col("__p"))
    return placed.withColumn("position", (F.col("__base") + F.col("__i") - 1).cast("long")).drop("__part", "__p", "__base", "__i")

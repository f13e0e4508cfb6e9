"""Key lookups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in HOT_SHARE of the rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 500
#: Below this many rows a single task handles any key.
HOT_ROWS = 1_000_000


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, n_rows: int, *, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to ``table``, whose ``table_key`` is unique.

    Rows with a hot key meet a broadcast of at most ``HOT_SHARE`` table rows, so no task ever receives them together; all other
    rows take the ordinary shuffle join. The result is that of one join. ``rows`` should be materialised: it is read three times.
    """
    table = table.withColumnRenamed(table_key, "__key").hint("merge")  # tables here grow with the data: no unchecked broadcast
    if n_rows < hot_rows:
        return rows.join(table, F.col(key) == F.col("__key"), how).drop("__key")
    hot = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > n_rows / HOT_SHARE).select("__hot")
    cold = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_anti").join(table, F.col(key) == F.col("__key"), how)
    known = table.join(F.broadcast(hot), F.col("__key") == F.col("__hot"), "left_semi")
    warm = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_semi").join(F.broadcast(known), F.col(key) == F.col("__key"), how)
    return cold.unionByName(warm).drop("__key")


#: Most rows of keys that are broadcast; they are counted first.
SMALL_ROWS = 100_000


def rows_of(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``keys`` (one materialised column without repeats): by a broadcast up to a counted size, so
    ``rows`` stay where they are, and by a shuffle join beyond it."""
    named = keys.toDF("__key")
    few = keys.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(named) if few else named.hint("merge"), F.col(key) == F.col("__key"), "left_semi")


#: Tasks that share the pairs of a hot key.
SPREAD = 32


def spread_join(left: DataFrame, right: DataFrame, key: str, n_rows: int, *, hot_rows: int = HOT_ROWS, spread: int = SPREAD) -> DataFrame:
    """Inner join of two tables of which neither has unique keys, for instance the members of a bucket with one another.

    A key with more than one part in HOT_SHARE of the ``n_rows`` rows of ``left`` would make all its pairs in one task. Its left rows are
    dealt to ``spread`` tasks by their hash and its right rows are sent to each of them; the result is that of one join. ``left`` should
    be materialised: it is read three times where ``n_rows`` reaches ``hot_rows``.
    """
    if n_rows < hot_rows:
        return left.hint("merge").join(right, key)
    hot = left.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > n_rows / HOT_SHARE).select("__hot", F.lit(True).alias("__is"))
    mark = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    part = F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int")
    dealt = mark(left).withColumn("__part", F.when(F.col("__is"), part).otherwise(F.lit(0))).drop("__hot", "__is")
    every = F.explode(F.when(F.col("__is"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))
    sent = mark(right).withColumn("__part", every).drop("__hot", "__is")
    return dealt.hint("merge").join(sent, [key, "__part"]).drop("__part")

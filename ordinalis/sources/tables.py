"""Readers for the parquet tables and the id and file-name rules they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID_WIDTH = 9


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes the columns."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pad_id(column: Column | str, width: int = ID_WIDTH) -> Column:
    """Give lost leading zeros back; ids that are long enough stay whole (plain ``lpad`` would cut them)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def canonical_id(column: Column | str) -> Column:
    """Nine lower-case hexadecimal characters, however the id was written; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return pad_id(F.lower(F.trim(c)))

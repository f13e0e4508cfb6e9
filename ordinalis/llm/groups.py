"""Problem 1: pairwise match results become one group identifier per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.hooking import connected_components
from ordinalis.sources.tables import canonical_id


def match_groups(pairs: DataFrame, *, hot_rows: int | None = None) -> DataFrame:
    """(kind, rec_key, group_key) of every pet and photo in a group of two or more.

    ``pairs`` has pair_kind, key_a, key_b and is_match. A link is a row with is_match true and both keys not null; undecided rows,
    rows of a key with itself, other or null kinds, and the score do not count. Pet keys are compared in their nine-character
    lower-case form, photo keys as written. Repeats and either order are one link. Empty input gives no rows.
    """
    key = lambda c: F.concat(F.col("pair_kind"), F.lit(":"), F.when(F.col("pair_kind") == "pet", canonical_id(c)).otherwise(F.col(c)))
    links = pairs.where("is_match and pair_kind in ('pet', 'photo') and key_a is not null and key_b is not null").select(key("key_a").alias("a"), key("key_b").alias("b"))
    found = connected_components(links, **({} if hot_rows is None else {"hot_rows": hot_rows}))
    return found.select(F.substring_index("node", ":", 1).alias("kind"), F.expr("substr(node, instr(node, ':') + 1)").alias("rec_key"), F.expr("substr(component, instr(component, ':') + 1)").alias("group_key"))

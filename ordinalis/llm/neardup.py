"""Problem 4: texts that are small rewrites of one another, by tensored banding.

Plain banding with ``m * m`` tables needs ``m * m`` independent bands of minhashes. Here two collections of ``m`` small bands are made
and every table's key combines one band of the first with one of the second: ``2 * m`` bands give ``m * m`` tables. A pair of
similarity s falls together in some table with probability ``(1 - (1 - s ** r) ** m) ** 2`` (r minhashes to a band). ``bands`` takes r and
m from the threshold, so that a pair at it is missed with a probability of at most ``MISS``; pairs above it are missed less.

No table is written out. Two texts stand in one cell of some table if they agree in a band of the first collection and in one of the
second; so a text goes to the buckets of its ``m`` first bands only, with its second bands beside it, and the second agreement is
looked up where two texts meet. Pairs of close sketches are verified exactly on their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm import shingles as S
from ordinalis.llm.hooking import connected_components
from ordinalis.operators.lookup import HOT_ROWS, rows_of, spread_join
from ordinalis.session import cut
from ordinalis.sources.tables import canonical_id

#: Accepted probability to miss a pair at the threshold, and the most bands of a collection.
MISS, MOST_BANDS = 1e-3, 32


def bands(threshold: float, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands of a collection, minhashes to a band): the longest bands, so the fewest chance meetings, that need at most ``most``."""
    need = lambda depth: math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - threshold**depth)) if threshold < 1 else 1
    depth = 1
    while depth < 16 and need(depth + 1) <= most:
        depth += 1
    return need(depth), depth


def prepare(rows: DataFrame, key: str, text: str, threshold: float = S.SIMILARITY, *, run: int = S.RUN, min_words: int = S.MIN_WORDS) -> DataFrame:
    """(rec, cls, shingles, s1, ..., first, second) of every text with at least ``min_words`` words; cls names its set of shingles."""
    m, depth = bands(threshold)
    multipliers, bits = S.seeds(2 * m * depth, 4), S.seeds(S.SKETCH, 3)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            with np.errstate(over="ignore"):
                for rec, t in zip(batch["rec"], batch["txt"], strict=True):
                    tokens = S.words(t)
                    if len(tokens) < max(min_words, run):
                        continue
                    sh = S.shingle_set(S.word_hashes(tokens), run)
                    first, second = S.band_values(sh, multipliers, m, depth)
                    out.append((rec, S.class_of(sh), S.signed(sh), *S.sketch(sh, bits), first, second.astype(np.int16)))
            yield pd.DataFrame(out, columns=["rec", "cls", "shingles", *S.SKETCH_COLUMNS, "first", "second"])

    kind = rows.schema[key].dataType.simpleString()
    schema = f"rec {kind}, cls binary, shingles array<long>, {', '.join(f'{c} long' for c in S.SKETCH_COLUMNS)}, first array<long>, second array<smallint>"
    return rows.select(F.col(key).alias("rec"), F.col(text).alias("txt")).where("rec is not null and txt is not null").mapInPandas(make, schema)


def meeting(classes: DataFrame, threshold: float, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(c1, c2) of the classes that share a cell of some table; ``classes`` has cls, the sketch, first and second. The pairs of a bucket
    that holds many classes are made by several tasks."""
    buckets = classes.select("cls", *S.SKETCH_COLUMNS, "second", F.posexplode("first").alias("i", "a")).select("cls", *S.SKETCH_COLUMNS, "second", F.xxhash64("i", "a").alias("bucket"))
    side = lambda c, mark: buckets.select("bucket", F.col("cls").alias(c), F.col("second").alias(f"{mark}second"), *(F.col(s).alias(f"{mark}{s}") for s in S.SKETCH_COLUMNS))
    met = spread_join(side("c1", "x"), side("c2", "y"), "bucket", classes.count(), hot_rows=hot_rows)
    cell = F.exists(F.zip_with("xsecond", "ysecond", lambda x, y: x == y), lambda same: same)
    return met.where((F.col("c1") < F.col("c2")) & S.close("x", "y", threshold) & cell).select("c1", "c2").distinct()


def class_pairs(prepared: DataFrame, threshold: float = S.SIMILARITY, *, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members(rec, cls), pairs(c1, c2, similarity)): texts with one shingle set are one class, so copies cost nothing further."""
    prepared = cut(prepared)
    merged = prepared.groupBy("cls").agg(*(F.first(c).alias(c) for c in (*S.SKETCH_COLUMNS, "first", "second")))
    named = cut(merged.withColumn("id", F.monotonically_increasing_id()))  # short names, fixed by writing them down
    names, classes = named.select("id", F.col("cls").alias("__cls")), named.drop("cls").withColumnRenamed("id", "cls")
    members = prepared.select("rec", F.col("cls").alias("__cls")).distinct().join(names.hint("merge"), "__cls").select("rec", F.col("id").alias("cls"))
    met = cut(meeting(classes, threshold, hot_rows=hot_rows))
    asked = cut(rows_of(names, "id", cut(met.select(F.explode(F.array("c1", "c2")).alias("cls")).distinct())))
    words = rows_of(prepared.select("cls", "shingles"), "cls", asked.select("__cls")).groupBy(F.col("cls").alias("__cls")).agg(F.first("shingles").alias("s"))
    sets = words.join(asked.hint("merge"), "__cls").select(F.col("id").alias("cls"), "s")
    both = met.join(sets.select(F.col("cls").alias("c1"), F.col("s").alias("a")).hint("merge"), "c1").join(sets.select(F.col("cls").alias("c2"), F.col("s").alias("b")).hint("merge"), "c2")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike = [S.similarity(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)]
            made = pd.DataFrame({"c1": batch["c1"], "c2": batch["c2"], "similarity": np.array(alike, float)})
            yield made[made["similarity"] >= threshold]

    return members, cut(both.mapInPandas(verify, "c1 long, c2 long, similarity double"))


def near_pairs(rows: DataFrame, key: str, text: str, threshold: float = S.SIMILARITY, *, hot_rows: int = HOT_ROWS, **parameters) -> DataFrame:
    """(a, b) of all pairs of different keys whose texts have at least the similarity ``threshold``, smaller key first.

    Rows with a null key or text, and texts under ``min_words`` words, have no pairs; repeated rows count once; a key with several
    texts pairs by any of them and never with itself. Empty input gives no rows.
    """
    members, pairs = class_pairs(prepare(rows, key, text, threshold, **parameters), threshold, hot_rows=hot_rows)
    left = members.select(F.col("rec").alias("x"), F.col("cls").alias("c1"))
    right = members.select(F.col("rec").alias("y"), F.col("cls").alias("c2"))
    across = pairs.select("c1", "c2").join(left, "c1").join(right, "c2").select("x", "y")
    within = left.join(right, F.col("c1") == F.col("c2")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(rows: DataFrame, key: str, text: str, threshold: float = S.SIMILARITY, *, hot_rows: int = HOT_ROWS, **parameters) -> DataFrame:
    """(rec, group_key, n_links): one row per text that takes part; group_key is the smallest key linked to it directly or through
    others, n_links the number of other keys with a similar text. Copies are never expanded into pairs."""
    members, pairs = class_pairs(prepare(rows, key, text, threshold, **parameters), threshold, hot_rows=hot_rows)
    members = cut(members)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("rec").alias("least"))
    ends = pairs.select(F.col("c1").alias("cls"), F.col("c2").alias("other")).unionByName(pairs.select(F.col("c2").alias("cls"), F.col("c1").alias("other")))
    links = ends.join(sizes.select(F.col("cls").alias("other"), "n"), "other").groupBy("cls").agg(F.sum("n").alias("far"))
    components = connected_components(pairs, "c1", "c2").withColumnRenamed("node", "cls")
    whole = sizes.join(components, "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = cut(whole.select("cls", "component", "least", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")))
    keys = named.groupBy("component").agg(F.min("least").alias("group_key"))
    return members.join(named.join(keys, "component").select("cls", "group_key", "n_links"), "cls").groupBy("rec").agg(F.min("group_key").alias("group_key"), F.max("n_links").cast("long").alias("n_links"))


def train_pairs(train: DataFrame) -> DataFrame:
    rows = train.select(canonical_id("PetID").alias("petid"), "Description").distinct()
    return near_pairs(rows, "petid", "Description").select(F.col("a").alias("petid_a"), F.col("b").alias("petid_b"))


def train_groups(train: DataFrame) -> DataFrame:
    rows = train.select(canonical_id("PetID").alias("petid"), "Description").distinct()
    return near_groups(rows, "petid", "Description").withColumnRenamed("rec", "petid")

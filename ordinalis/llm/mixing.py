"""Problem 8: mixing sources to target shares of all tokens.

The texts of every source are packed into blocks of a fixed number of tokens. The mixture is the largest at which no source
needs a block more often than its cap, unless a total is given; every source gets slots for its share of it. Slots are divided over output shards by
splitting the totals down a binary tree with multivariate hypergeometric draws: each shard's counts are multinomial draws given the
totals, and any shard can be computed alone, with the number of slots before it. Slot j of a source is the (j mod n)-th block of a
pseudorandom permutation (a Feistel network, one key per source and repetition), so the blocks follow by a join on their index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.llm.encode import encode_column, vocabulary_of
from ordinalis.operators.lookup import SMALL_ROWS
from ordinalis.session import cut

#: Tokens to a block, slots to an output shard, documents to a bin of the running sum.
BLOCK, SHARD, BIN = 512, 256, 20_000
#: Slots from which the generator's own hypergeometric draw is out of range.
LARGE = 900_000_000


def pack(documents: DataFrame, targets: DataFrame, *, path: str | None = None, block: int = BLOCK, seed: int = 8) -> DataFrame:
    """(source, block_no, ids, first_doc, n_docs): the tokens of every wanted source in blocks of ``block``; the last may be shorter.

    Exact copies of a text count once, in the record with the smallest doc_id. Null and empty texts, null sources and sources that are
    not in ``targets`` take no part. Documents follow one another in a pseudorandom order. The running sum of tokens is taken inside
    bins and over bins, so a source of any size is never in one task.
    """
    wanted = documents.where("doc_id is not null and text is not null and text <> ''").join(targets.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "text")
    # Only the texts that have copies are looked up, so the others need not be shuffled.
    digest = F.sha2("text", 256)
    copied = cut(wanted.groupBy(digest.alias("h")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least"))
    few = copied.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    known = wanted.join(F.broadcast(copied) if few else copied.hint("merge"), digest == F.col("h"), "left")
    once = known.where(F.col("h").isNull() | (F.col("doc_id") == F.col("least"))).select("doc_id", "source", "text")
    tokens = cut(encode_column(once, ["doc_id", "source"], path=path or vocabulary_of(documents.sparkSession)).where(F.size("ids") > 0))
    bins = max(1, -(-tokens.count() // BIN))
    placed = tokens.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bin", F.pmod("h", F.lit(bins)))
    sums = placed.groupBy("source", "bin").agg(F.sum(F.size("ids")).cast("long").alias("n"))
    before = sums.select("source", "bin", (F.sum("n").over(W.partitionBy("source").orderBy("bin")) - F.col("n")).alias("base"))
    inside = F.sum(F.size("ids")).over(W.partitionBy("source", "bin").orderBy("h", "doc_id")) - F.size("ids")
    at = placed.withColumn("inside", inside).join(before, ["source", "bin"]).withColumn("start", (F.col("base") + F.col("inside")).cast("long"))
    # The array is cut before it is exploded, so a long document is not repeated whole in each of its blocks.
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.size("ids") - 1) / block)

    def piece(number: Column) -> Column:
        begin = F.greatest(number * block - F.col("start"), F.lit(0))
        end = F.least((number + 1) * block - F.col("start"), F.size("ids"))
        return F.struct(number.alias("block_no"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))

    parts = at.select("source", "doc_id", "start", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("source", "doc_id", "start", "p.block_no", "p.ids")
    whole = parts.groupBy("source", "block_no").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "ids"))).alias("p"))
    return whole.select("source", "block_no", F.flatten("p.ids").alias("ids"), F.col("p")[0]["doc_id"].alias("first_doc"), F.size("p").alias("n_docs"))


def quotas(targets: pd.DataFrame, sizes: dict[str, tuple[int, int]], total: int | None = None) -> pd.DataFrame:
    """(source, share, n_blocks, slots) in source order, from the (blocks, tokens) of each source.

    The mixture has ``total`` tokens, or else the largest number at which all shares hold and no source exceeds its cap; a source's slots
    are its share of them over the mean length of its blocks. With a larger ``total`` a source that is used up stays at its cap, below its
    share. Shares are taken anew over the sources that have blocks.
    """
    rows = targets.dropna(subset=["source", "target_share", "max_repeats"]).groupby("source", as_index=False).agg({"target_share": "sum", "max_repeats": "min"}).sort_values("source", ignore_index=True)
    rows["n_blocks"] = [sizes.get(s, (0, 0))[0] for s in rows["source"]]
    rows["tokens"] = [sizes.get(s, (0, 0))[1] for s in rows["source"]]
    rows = rows[(rows["n_blocks"] > 0) & (rows["target_share"] > 0) & (rows["max_repeats"] > 0)].reset_index(drop=True)
    rows["share"] = rows["target_share"] / rows["target_share"].sum() if len(rows) else 0.0
    whole = (rows["max_repeats"] * rows["tokens"] / rows["share"]).min() if len(rows) else 0.0
    whole = whole if total is None else float(total)
    wanted = rows["share"] * whole * rows["n_blocks"] / rows["tokens"]
    rows["slots"] = np.minimum(np.floor(wanted + 0.5), rows["n_blocks"] * rows["max_repeats"]).astype(np.int64)
    return rows


def hypergeometric(counts: np.ndarray, take: int, *seed: int) -> np.ndarray:
    """How many of each kind are among ``take`` drawn without replacement, whatever the total."""
    if counts.sum() < LARGE:
        return np.random.default_rng(seed).multivariate_hypergeometric(counts, take, method="marginals")
    return np.array(_large_draw(tuple(counts.tolist()), take, seed), np.int64)


@lru_cache(maxsize=256)  # only the uppermost splits are so large, and every shard passes through them
def _large_draw(counts: tuple[int, ...], take: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    rng, rest, out = np.random.default_rng(seed), sum(counts), []
    for n in counts:
        rest -= n
        out.append(_large_marginal(n, rest, take, rng.random()))
        take -= out[-1]
    return tuple(out)


def _large_marginal(good: int, bad: int, take: int, u: float) -> int:
    """The quantile ``u`` of the hypergeometric distribution beyond the generator's range, by the ratios of neighbouring probabilities
    over all values within 12 standard deviations of the mode; the rest has a probability below 1e-30."""
    low, high = max(0, take - bad), min(good, take)
    total = good + bad
    if low == high:
        return low
    mode = min(max((good + 1) * (take + 1) // (total + 2), low), high)
    share = take / total
    reach = int(12 * (share * (1 - share) * good * (bad / total) * total / max(total - 1, 1)) ** 0.5) + 60
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)  # the step from k to k + 1
    steps = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return a + min(int(np.searchsorted(below, u * below[-1], side="right")), b - a)


def shard_counts(slots: np.ndarray, shard: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it): the same for every caller."""
    before, own = np.zeros(len(slots), np.int64), np.asarray(slots, np.int64)
    low, high = 0, -(-int(own.sum()) // size)
    while high - low > 1:
        mid = (low + high) // 2
        take = min((mid - low) * size, int(own.sum()))
        left = hypergeometric(own, take, seed, low, high)
        if shard < mid:
            own, high = left, mid
        else:
            before, own, low = before + left, own - left, mid
    return before, own


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of each index below ``n`` under a pseudorandom permutation: four Feistel rounds, walking until inside the range."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(4):
                f = (right + np.uint64(key % (1 << 63) + r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def slot_table(spark, plan: pd.DataFrame, *, shard: int = SHARD, seed: int = 8) -> DataFrame:
    """(shard, slot, source, repeat_no, block_no): which block stands where; every shard is drawn alone."""
    names, slots, blocks = list(plan["source"]), plan["slots"].to_numpy(np.int64), plan["n_blocks"].to_numpy(np.int64)
    keys = [xxhash.xxh3_64_intdigest(s, seed=seed) for s in names]
    shards = -(-int(slots.sum()) // shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                before, own = shard_counts(slots, int(number), shard, seed)
                source = np.repeat(np.arange(len(own)), own)
                j = np.concatenate([b + np.arange(k) for b, k in zip(before, own, strict=True)]) if len(source) else np.zeros(0, np.int64)
                repeat, place = j // blocks[source], j % blocks[source]
                block = np.zeros(len(j), np.int64)
                for s in np.unique(source):
                    for r in np.unique(repeat[source == s]):
                        here = (source == s) & (repeat == r)
                        block[here] = permuted(place[here], int(blocks[s]), (keys[s] + int(r) * 0x632BE59BD9B4E019) % (1 << 64))
                order = np.random.default_rng([seed, 1, int(number)]).permutation(len(j))
                yield pd.DataFrame({"shard": int(number), "slot": np.arange(len(j)), "source": [names[s] for s in source[order]], "repeat_no": repeat[order] + 1, "block_no": block[order]})

    return spark.range(shards).mapInPandas(draw, "shard long, slot int, source string, repeat_no int, block_no long")


def mix(documents: DataFrame, targets: DataFrame, *, path: str | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = 8, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture(shard, slot, source, repeat_no, block_no, n_tokens, first_doc, ids), shares(source, target_share, max_repeats,
    source_tokens, mixed_tokens, actual_share, uses)). Empty inputs give an empty mixture. A source without texts keeps its row in the
    shares, with 0 tokens; its share then falls to the others in proportion. ``total`` is as in ``quotas``."""
    spark = documents.sparkSession
    blocks = cut(pack(documents, targets, path=path, block=block, seed=seed))
    sizes = blocks.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("tokens"))
    asked = targets.select("source", "target_share", "max_repeats").toPandas()
    plan = quotas(asked, {r["source"]: (r["n"], r["tokens"]) for r in sizes.collect()}, total)
    slots = slot_table(spark, plan, shard=shard, seed=seed)
    mixture = slots.join(blocks.hint("merge"), ["source", "block_no"]).select("shard", "slot", "source", "repeat_no", "block_no", F.size("ids").alias("n_tokens"), "first_doc", "ids")
    light = slots.join(blocks.select("source", "block_no", F.size("ids").alias("n")).hint("merge"), ["source", "block_no"]).groupBy("source").agg(F.sum("n").alias("mixed"), F.max("repeat_no").alias("uses"))
    got = targets.join(sizes, "source", "left").join(light, "source", "left")
    whole = F.sum("mixed").over(W.partitionBy())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    shares = got.select("source", "target_share", "max_repeats", zero("tokens").alias("source_tokens"), zero("mixed").alias("mixed_tokens"), F.coalesce(F.col("mixed") / whole, F.lit(0.0)).alias("actual_share"), zero("uses").alias("uses"))
    return mixture, shares

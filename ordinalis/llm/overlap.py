"""Problem 3: records of the evaluation split that also stand in the training split, by bands of minhashes.

Every text is reduced to ``S.SKETCH`` minhashes of its shingles; a band is a few of them together, and a pair meets if a band is equal.
``band_depth`` takes their length from the threshold, so that a pair at it misses all bands with a probability of at most ``MISS``, pairs
above it with less. A frequent phrase is one shingle among many and brings texts together only if it stands in all places of a band, so
texts that share no more than phrases seldom meet, however many of them there are.

No band is shuffled. The texts of either split are packed into blocks, every block of one meets every block of the other where they
lie in the checkpoint folder, and equal bands are looked up there by tables of 16 bits. Of those that meet, the minhashes tell who is compared.

The fingerprints (the minima of a rolling hash over windows of runs of words) of the pairs left are matched, chained collinearly and
extended word by word. If the aligned stretches hold enough common shingles the pair is found; else, as for texts in another order, the
shingle sets decide. The stretches give the coverage.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm import shingles as S
from ordinalis.operators.lookup import HOT_ROWS, rows_of
from ordinalis.session import cut
from ordinalis.sources.tables import canonical_id

#: Runs in a window.
WINDOW = 4
#: Accepted probability to miss a pair at the threshold.
MISS = 2e-5
#: Texts of either split in a block, texts whose minhashes are made at once, and meetings that are looked at together.
BLOCK, CHUNK, PIECE = 65_536, 2_048, 250_000


def band_depth(threshold: float) -> int:
    """Minhashes to a band: as many as ``MISS`` allows, so that chance meetings are fewest."""
    depth = 1
    while depth < 16 and (1 - threshold ** (depth + 1)) ** (S.SKETCH // (depth + 1)) <= MISS:
        depth += 1
    return depth


#: A text in a block: the name of its sequence of words, and a byte of each of its minhashes.
RECORD = np.dtype([("cls", "<u8", 2), ("minima", "u1", S.SKETCH)])


def records(texts: list[list[str]]) -> np.ndarray:
    """The ``RECORD`` of each of some lists of at least ``S.RUN`` words."""
    out, counts = np.empty(len(texts), RECORD), np.array([len(t) for t in texts], np.int64)
    hashes = S.word_hashes([w for t in texts for w in t])
    out["minima"] = S.minhashes(S.joined_runs(hashes, counts), np.cumsum(counts) - counts, S.seeds(S.SKETCH, 3)).T
    out["cls"] = np.frombuffer(b"".join(S.class_of(h) for h in np.split(hashes, np.cumsum(counts)[:-1])), "<u8").reshape(-1, 2)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a contiguous array."""
    size = rows.nbytes // len(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(rows.tobytes())])


def prepare(rows: DataFrame, *, min_words: int = S.MIN_WORDS) -> DataFrame:
    """(split, rec, source, hash, cls, data) of each row (split, rec, source, text) with at least ``min_words`` words; hash is that of the text
    as written, cls names the sequence of words, data is its ``RECORD``."""
    least = max(min_words, S.RUN)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                texts = [S.words(t) for t in batch["text"].to_pylist()]
                long = [k for k, t in enumerate(texts) if len(t) >= least]
                if not long:
                    continue
                with np.errstate(over="ignore"):
                    made = records([texts[k] for k in long])
                kept = batch.take(pa.array(long, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept[c] for c in ("split", "rec", "source", "hash")] + [_binary(np.ascontiguousarray(made["cls"])), _binary(made)], names=["split", "rec", "source", "hash", "cls", "data"])

    kept = _hashed(rows).select("split", "rec", "source", "hash", "text")
    return kept.mapInArrow(make, "split string, rec string, source string, hash long, cls binary, data binary")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.where("rec is not null and text is not null").withColumn("hash", F.xxhash64("text"))


def _blocks(prepared: DataFrame, split: str, n: int, block: int) -> DataFrame:
    """(data): the different records of a split, one row for each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        for batch in batches:
            held |= zip(batch["cls"].to_pylist(), batch["data"].to_pylist(), strict=True)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held.values())], pa.binary())], names=["data"])

    return prepared.where(F.col("split") == split).select("cls", "data").repartition(max(1, -(-n // block)), "cls").mapInArrow(pack, "data binary")


def bands_of(minima: np.ndarray, threshold: float) -> np.ndarray:
    """16 bits for every band of the records of a block, a row to each band."""
    depth, columns = band_depth(threshold), np.ascontiguousarray(minima.T)
    out = np.empty((len(columns) // depth, len(minima)), np.uint16)
    for k, row in enumerate(out):  # one by one, because the sums of all would take more memory than the block
        parts = columns[k * depth : (k + 1) * depth] * S.seeds(depth, 11)[:, None]
        row[:] = S.mix(parts.sum(axis=0, dtype=np.uint64)) >> np.uint64(48)
    return out


def least_equal(threshold: float) -> float:
    """Equal minhashes from which a pair may reach ``threshold``, with as small a probability to lose one as ``S.most_bits`` has."""
    return S.SKETCH * threshold - S.DEVIATIONS * math.sqrt(S.SKETCH * threshold * (1 - threshold))


def block_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of the records that have an equal band, close sketches (the low bits of their minhashes) and enough equal
    minhashes, each pair once."""
    most, least, cells = S.most_bits(threshold), least_equal(threshold), 1 << 16
    minima_a, minima_b = (np.ascontiguousarray(x["minima"]) for x in (a, b))
    sketch_a, sketch_b = (np.packbits(x & 1, axis=1).view(np.uint64) for x in (minima_a, minima_b))
    found = [np.zeros(0, np.int64)]
    for band_a, band_b in zip(bands_of(minima_a, threshold), bands_of(minima_b, threshold), strict=True):
        order, held = np.argsort(band_a, kind="stable").astype(np.int32), np.bincount(band_a, minlength=cells)
        first, count = (np.cumsum(held) - held)[band_b], held[band_b]
        ends = np.cumsum(count)
        total = int(ends[-1])
        edges = np.unique(np.searchsorted(ends, np.arange(0, total, PIECE), side="left")).tolist()
        for start, stop in zip(edges, [*edges[1:], len(b)] if total else [], strict=True):
            c = count[start:stop]
            right = np.repeat(np.arange(start, stop, dtype=np.int32), c)
            left = order[np.arange(len(right)) + np.repeat(first[start:stop] - (ends[start:stop] - c) + ends[start] - count[start], c)]
            bits = np.bitwise_count(sketch_a[left] ^ sketch_b[right])
            near = np.flatnonzero(np.einsum("ij->i", bits, dtype=np.uint16) <= most)
            left, right = left[near], right[near]
            for k in range(0, len(near), CHUNK):
                x, y = left[k : k + CHUNK], right[k : k + CHUNK]
                near = (minima_a[x] == minima_b[y]).sum(axis=1) >= least
                found.append(x[near].astype(np.int64) * len(b) + y[near])
        found = [np.unique(np.concatenate(found))]
    return np.divmod(found[0], len(b))


def meeting(prepared: DataFrame, threshold: float, *, block: int = BLOCK) -> DataFrame:
    """(train_cls, test_cls) of the classes of either split that share a band and have minhashes enough in common, among them those that stand in both."""
    n = dict(prepared.groupBy("split").count().collect())
    side = lambda split: cut(_blocks(prepared, split, n.get(split, 0), block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch["a"], batch["b"], strict=True):
                a, b = (np.frombuffer(z.as_buffer(), RECORD) for z in (x, y))
                i, j = block_pairs(a, b, threshold)
                if len(i):
                    yield pa.RecordBatch.from_arrays([_binary(np.ascontiguousarray(a["cls"][i])), _binary(np.ascontiguousarray(b["cls"][j]))], names=["train_cls", "test_cls"])

    # each row is a block, so a task has one pair of them
    return side("train").toDF("a").hint("shuffle_replicate_nl").crossJoin(side("test").toDF("b")).mapInArrow(run, "train_cls binary, test_cls binary")


class Text:
    """The words of a text with what a comparison needs of them: its runs, the different ones, and the fingerprints with their first places."""

    __slots__ = ("at", "kinds", "prints", "runs", "words")

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.runs = words, S.rolling(words, S.RUN)
        self.kinds = np.unique(self.runs)
        places = S.winnow(self.runs, WINDOW)
        self.prints, first = np.unique(self.runs[places], return_index=True)
        self.at = places[first]


def matches(a: Text, b: Text) -> list[tuple[int, int]]:
    """The places at which a fingerprint of both texts stands; of one that stands several times in a text, its first place."""
    _, i, j = np.intersect1d(a.prints, b.prints, assume_unique=True, return_indices=True)
    return list(zip(a.at[i].tolist(), b.at[j].tolist(), strict=True))


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds that rises in both texts."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seeds)
    for k, (_, y) in enumerate(seeds):
        p = bisect_left(tails, y)
        if p == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[p], at[p] = y, k
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def extend(a: np.ndarray, b: np.ndarray, chained: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of the aligned stretches: every seed grown in both directions, inside what is not aligned yet."""
    out: list[tuple[int, int, int]] = []
    done_a = done_b = 0
    for x, y in chained:
        if x < done_a or y < done_b:
            continue
        back = min(x - done_a, y - done_b)
        same = a[x - back : x][::-1] == b[y - back : y][::-1]
        k = back if same.all() else int(same.argmin())
        far = min(len(a) - x, len(b) - y)
        same = a[x : x + far] == b[y : y + far]
        m = far if same.all() else int(same.argmin())
        if k + m:
            out.append((x - k, y - k, k + m))
            done_a, done_b = x + m, y + m
    return out


def aligned(a: Text, b: Text, threshold: float) -> tuple[float, int]:
    """(similarity, words aligned) of two texts. The similarity is that of the aligned stretches where it reaches the threshold, which is
    never above the true one, and else the true one."""
    stretches = extend(a.words, b.words, chain(matches(a, b)))
    inside = [a.runs[x : x + n - S.RUN + 1] for x, _, n in stretches if n >= S.RUN]
    shared = len(np.unique(np.concatenate(inside))) if inside else 0
    alike = shared / (len(a.kinds) + len(b.kinds) - shared)
    return alike if alike >= threshold else S.similarity(a.kinds, b.kinds), sum(n for _, _, n in stretches)


#: Texts that a task keeps ready between pairs.
KEPT = 4096


def overlaps(rows: DataFrame, threshold: float = S.SIMILARITY, *, min_words: int = S.MIN_WORDS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members(split, rec, source, cls), pairs(train_cls, test_cls, similarity, train_cover, test_cover)).

    ``rows`` has split ('train' or 'test'), rec, source and text. One class holds all records with the same words, so copies are
    compared once; a class that stands in both splits is a pair with itself. Null and short texts take no part. ``similarity`` is a
    lower bound (see ``aligned``). No task holds more than ``hot_rows`` texts of a split, but for chance.
    """
    prepared = cut(prepare(rows, min_words=min_words))
    members = prepared.select("split", "rec", "source", "cls").distinct()
    met = cut(meeting(prepared, threshold, block=min(BLOCK, hot_rows)))
    apart = met.where("train_cls <> test_cls")
    asked = cut(rows_of(prepared.select("cls", "hash"), "cls", cut(apart.select(F.explode(F.array("train_cls", "test_cls")).alias("cls")).distinct())).groupBy("cls").agg(F.min("hash").alias("hash")))
    wanted = rows_of(_hashed(rows).select("hash", "text"), "hash", cut(asked.select("hash").distinct())).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [S.word_hashes(S.words(t)) for t in batch["text"]]
            yield pd.DataFrame({"cls": [S.class_of(h) for h in hashes], "tokens": [S.signed(h) for h in hashes]})

    texts = cut(wanted.select("text").mapInPandas(split, "cls binary, tokens array<long>").groupBy("cls").agg(F.first("tokens").alias("tokens")))
    pairs = apart.join(texts.select(F.col("cls").alias("train_cls"), F.col("tokens").alias("a")).hint("merge"), "train_cls").join(texts.select(F.col("cls").alias("test_cls"), F.col("tokens").alias("b")).hint("merge"), "test_cls")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, Text] = {}

        def text(cls: bytes, words: np.ndarray) -> Text:
            if cls not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[cls] = Text(np.asarray(words, np.int64).view(np.uint64))
            return known[cls]

        for batch in batches:
            out = []
            with np.errstate(over="ignore"):
                for p, q, a, b in batch[["train_cls", "test_cls", "a", "b"]].itertuples(index=False):
                    alike, n = aligned(text(p, a), text(q, b), threshold)
                    if alike >= threshold:
                        out.append((p, q, alike, n / len(a), n / len(b)))
            yield pd.DataFrame(out, columns=["train_cls", "test_cls", "similarity", "train_cover", "test_cover"])

    near = pairs.mapInPandas(align, "train_cls binary, test_cls binary, similarity double, train_cover double, test_cover double")
    same = met.where("train_cls = test_cls").select("train_cls", "test_cls", *(F.lit(1.0).alias(c) for c in ("similarity", "train_cover", "test_cover")))
    return members, cut(near.unionByName(same))


def listing_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    part = lambda df, split: df.select(F.lit(split).alias("split"), canonical_id("PetID").alias("rec"), "source", F.col("Description").alias("text"))
    return part(train, "train").unionByName(part(test, "test")).distinct()


_NAME = r"^(?:img[-_])?([0-9a-f]{1,9})[-_](\d+)(?:-copy| ?\(\d+\))*\.[a-z]+$"


def photo_names(index: DataFrame) -> DataFrame:
    """(path, folder, pet, number, source): what each file name says; source is the folder below the split. Rows without a path or
    a readable name are left out, repeated rows count once."""
    flat = F.lower(F.regexp_replace("path", r"\\", "/"))
    base = F.regexp_extract(flat, r"([^/]+)$", 1)
    pet, number = F.regexp_extract(base, _NAME, 1), F.regexp_extract(base, _NAME, 2)
    folder = F.regexp_extract(flat, r"(?:^|/)(train|test)/", 1)
    rows = index.where("path is not null").select("path").distinct().select("path", folder.alias("folder"), F.lpad(pet, 9, "0").alias("pet"), F.regexp_replace(number, "^0+(?=.)", "").alias("number"), F.regexp_extract(flat, r"(?:train|test)/(?:(.+)/)?[^/]+$", 1).alias("source"))
    return rows.where("folder <> '' and number <> ''")


def photo_pairs(index: DataFrame) -> DataFrame:
    """(train_path, test_path): files below both split folders that name the same pet and photo number."""
    named = photo_names(index)
    side = lambda folder: named.where(F.col("folder") == folder).select("pet", "number", F.col("path").alias(f"{folder}_path"))
    return side("train").join(side("test"), ["pet", "number"]).select("train_path", "test_path")


def found(train: DataFrame, test: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, key_a, key_b) of all overlapping texts and photos, smaller key first."""
    members, pairs = overlaps(listing_rows(train, test))
    side = lambda split: members.where(F.col("split") == split).select(F.col("cls").alias(f"{split}_cls"), F.col("rec").alias(f"{split}_rec")).distinct()
    texts = pairs.select("train_cls", "test_cls").join(side("train"), "train_cls").join(side("test"), "test_cls").select("train_rec", "test_rec").distinct()
    pick = lambda kind, x, y: (F.lit(kind).alias("kind"), F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b"))
    return texts.select(*pick("text", "train_rec", "test_rec")).unionByName(photo_pairs(index).select(*pick("photo", "train_path", "test_path"))).distinct()


def _text_overlaps(train: DataFrame, test: DataFrame) -> DataFrame:
    """(split, source, rec, n_partners, cover) of every text record; a record with several partners or texts counts with its best cover,
    and without any the last two are null."""
    members, pairs = overlaps(listing_rows(train, test))
    best = lambda split, other: pairs.groupBy(F.col(f"{split}_cls").alias("cls")).agg(F.max(f"{split}_cover").alias("cover"), F.countDistinct(f"{other}_cls").alias("n_partners")).withColumn("split", F.lit(split))
    texts = members.join(best("train", "test").unionByName(best("test", "train")), ["split", "cls"], "left")
    return texts.groupBy("split", "source", "rec").agg(F.max("n_partners").alias("n_partners"), F.max("cover").alias("cover"))


def coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """(split, source, petid, n_partners, cover) of every overlapping record: how many different texts of the other split it overlaps with,
    and the part of its words that the best aligned one covers."""
    return _text_overlaps(train, test).where(F.col("cover").isNotNull()).withColumnRenamed("rec", "petid")


def report(train: DataFrame, test: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, split, source, n_records, n_overlapping) per split and source; a null source has its own row."""
    texts = _text_overlaps(train, test).groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("cover").alias("n_overlapping")).select(F.lit("text").alias("kind"), "*")
    named = photo_names(index)
    hit = photo_pairs(index)
    hit = hit.select(F.col("train_path").alias("path")).unionByName(hit.select(F.col("test_path").alias("path"))).distinct().withColumn("hit", F.lit(1))
    photos = named.join(hit, "path", "left").groupBy(F.col("folder").alias("split"), "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping")).select(F.lit("photo").alias("kind"), "*")
    return texts.unionByName(photos)

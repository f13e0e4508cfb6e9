"""Near duplicates and overlaps against brute force over all pairs."""

import random

import numpy as np
import pytest

from ordinalis.llm import neardup, overlap
from ordinalis.llm import shingles as S


def make_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for g in range(n // 4):
        base = [rng.choice(words) for _ in range(rng.randint(44, 90))]
        for copy in range(4):
            t = list(base)
            for _ in range(copy * rng.randint(0, 4)):
                p = rng.randrange(len(t))
                rng.choice([lambda: t.insert(p, rng.choice(words)), lambda: t.__setitem__(p, rng.choice(words)), lambda: t.pop(p) if len(t) > 41 else None])()
            out.append(" ".join(t))
    return out


def brute(a, b):
    sets = [[(k, frozenset(zip(w, w[1:], w[2:]))) for k, t in side if t and len(w := S.words(t)) >= 40] for side in (a, b)]
    return {(min(x, y), max(x, y)) for x, s in sets[0] for y, r in sets[1] if x != y and len(s & r) >= 0.5 * len(s | r)}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_near_pairs_and_groups(spark, hot_rows):
    texts = make_texts()
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts)] + [("k000", texts[0]), ("zcopy", texts[0].upper() + "!!"), ("null", None), (None, texts[0]), ("short", "too short"), ("empty", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, body string, cls int, s1 string")
    want = brute([r for r in rows if r[0]], [r for r in rows if r[0]])
    got = {(r.a, r.b) for r in neardup.near_pairs(df, "id", "body", hot_rows=hot_rows).collect()}
    assert got == want and ("k000", "zcopy") in got
    groups = {r.rec: (r.group_key, r.n_links) for r in neardup.near_groups(df, "id", "body").collect()}
    assert groups["zcopy"][0] == "k000" and "short" not in groups
    for k, (_, n) in groups.items():
        assert n == sum(k in p for p in want)
    assert neardup.near_pairs(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_overlaps(spark, hot_rows):
    texts = make_texts(seed=8)
    hot = " ".join(f"b{k}" for k in range(30))  # boilerplate in every text
    texts = [f"{t} {hot}" if k % 3 else t for k, t in enumerate(texts)]
    sides = {"train": [(f"a{k:03}", t) for k, t in enumerate(texts) if k % 4 < 2], "test": [(f"b{k:03}", t) for k, t in enumerate(texts) if k % 4 >= 2] + [("bcopy", texts[0])]}
    rows = [(s, k, None if k == "a000" else "src", t) for s, side in sides.items() for k, t in side] + [("train", None, "s", "x"), ("test", "n", "s", None)]
    df = spark.createDataFrame(rows, "split string, rec string, source string, text string")
    members, pairs = overlap.overlaps(df, hot_rows=hot_rows)
    rec = {}
    for r in members.collect():
        rec.setdefault((r.split, r.cls), []).append(r.rec)
    got = {(a, b) for p in pairs.collect() for a in rec["train", p.train_cls] for b in rec["test", p.test_cls]}
    want = brute(sides["train"], sides["test"])
    assert got == want and ("a000", "bcopy") in got
    assert all(0 <= p.train_cover <= 1 and 0 <= p.test_cover <= 1 for p in pairs.collect())
    _, none = overlap.overlaps(df.limit(0))
    assert none.count() == 0


def sides_of(spark, sides):
    return spark.createDataFrame([(s, k, "src", t) for s, side in sides.items() for k, t in side], "split string, rec string, source string, text string")


def pairs_of(df):
    members, pairs = overlap.overlaps(df)
    rec = {}
    for r in members.collect():
        rec.setdefault((r.split, r.cls), []).append(r.rec)
    return {tuple(sorted((a, b))) for p in pairs.collect() for a in rec["train", p.train_cls] for b in rec["test", p.test_cls]}


def test_evenly_edited_pairs_meet(spark):
    """Substitutions, insertions, deletions and moved blocks, spread as evenly as the threshold allows."""
    rng = random.Random(7)
    sides = {"train": [], "test": []}
    for k in range(720):
        n, every = (45, 80, 160)[k % 3], rng.choice((7, 8, 9, 10, 11))
        base = [f"w{k}x{i}" for i in range(n)]
        how = ("put", "insert", "drop", "move")[k // 3 % 4]
        if how == "move":
            blocks = [base[i : i + every] for i in range(0, n, every)]
            rng.shuffle(blocks)
            edited = [w for b in blocks for w in b]
        else:
            edited = [w for i, old in enumerate(base) for w in ([old] if i % every else {"put": [f"e{k}x{i}"], "insert": [f"e{k}x{i}", old], "drop": []}[how])]
        sides["train"].append((f"a{k:03}", " ".join(base)))
        sides["test"].append((f"b{k:03}", " ".join(edited)))
    rng.shuffle(sides["test"])
    want = {(f"a{k:03}", f"b{k:03}") for k in range(720)} & brute_matched(sides)
    assert len(want) > 400 and pairs_of(sides_of(spark, sides)) == want


def brute_matched(sides):
    train, test = dict(sides["train"]), dict(sides["test"])
    return {(a, f"b{a[1:]}") for a in train if brute([(a, train[a])], [(f"b{a[1:]}", test[f"b{a[1:]}"])])}


def test_large_groups_of_rewrites_meet(spark):
    rng = random.Random(5)
    sides = {"train": [], "test": []}
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(48)]
        for s, copies, edits in (("train", 40, (1, 2)), ("test", 20, (5, 6))):
            for k in range(copies):
                t = list(base)
                for p in rng.sample(range(48), rng.choice(edits)):
                    t[p] = f"{s}{g}x{k}x{p}"
                sides[s].append((f"{s}{g}x{k}", " ".join(t)))
    df = spark.createDataFrame([(s, k, "src", t) for s, side in sides.items() for k, t in side], "split string, rec string, source string, text string")
    want = brute(sides["train"], sides["test"])
    assert pairs_of(df) == want


def test_frequent_phrases_do_not_hide_a_pair(spark):
    """Texts made of the same few sentences in any order, and pairs among them that differ by a word or two."""
    rng = random.Random(3)
    phrases = [[f"p{s}x{i}" for i in range(12)] for s in range(8)]
    sides = {"train": [], "test": []}
    for k in range(200):
        t = [w for s in rng.sample(phrases, 5) for w in s]
        for p in rng.sample(range(60), rng.choice((0, 2, 5))):
            t[p] = f"q{k}x{p}"
        sides["train" if k % 2 else "test"].append((f"r{k:03}", " ".join(t)))
    assert pairs_of(sides_of(spark, sides)) == brute(sides["train"], sides["test"])


def phrase_texts(n, seed, own):
    """Texts of five out of thirty sentences, every sixth with a rewrite of itself."""
    rng = random.Random(seed)
    phrases = [[f"p{s}x{i}" for i in range(12)] for s in range(30)]
    out = []
    for k in range(n):
        t = [w for s in rng.sample(phrases, 5) for w in s]
        t[rng.randrange(60)] = f"{own}{k}"
        out.append(t)
        if k % 6 == 0:
            out.append([f"{own}{k}y{i}" if i in (9, 27, 45) else w for i, w in enumerate(t)])
    return out


def test_phrases_bring_few_texts_together(monkeypatch):
    """Where most texts share a fingerprint, few share a band, so the meetings do not grow as all pairs do; and no pair is lost."""
    sides = [phrase_texts(900, 1, "a"), phrase_texts(300, 2, "b")]
    sides[1] += [t[:30] + [f"z{k}"] + t[30:] for k, t in enumerate(sides[0][:200])] + sides[0][200:210]
    with np.errstate(over="ignore"):
        a, b = (overlap.records(side) for side in sides)
        prints = [[set(overlap.Text(S.word_hashes(t)).prints.tolist()) for t in side] for side in sides]
    n, shared = len(a) * len(b), sum(bool(p & q) for p in prints[0] for q in prints[1])
    met = sum(int((x[:, None] == y[None, :]).sum()) for x, y in zip(overlap.bands_of(a["minima"], 0.5), overlap.bands_of(b["minima"], 0.5), strict=True))
    sets = [[frozenset(zip(t, t[1:], t[2:])) for t in side] for side in sides]
    want = {(i, j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if len(x & y) >= 0.5 * len(x | y)}
    assert shared > 0.5 * n and met < 0.4 * n
    for piece in (overlap.PIECE, 7):
        monkeypatch.setattr(overlap, "PIECE", piece)
        found = list(zip(*(x.tolist() for x in overlap.block_pairs(a, b, 0.5)), strict=True))
        assert len(found) == len(set(found)) and want <= set(found) and len(want) > 200


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_bands_of_minhashes_follow_the_threshold(threshold):
    depth = overlap.band_depth(threshold)
    assert depth > 1 and (1 - threshold**depth) ** (S.SKETCH // depth) <= overlap.MISS


def test_joined_runs_are_those_of_each_text():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (3, 40, 5, 77)]
    with np.errstate(over="ignore"):
        joined = np.split(S.joined_runs(np.concatenate(texts), np.array([3, 40, 5, 77])), [3, 43, 48])
        for t, got in zip(texts, joined, strict=True):
            runs = S.rolling(t, S.RUN)
            assert (got[: len(runs)] == runs).all() and set(got.tolist()) == set(runs.tolist())


def test_chain_and_extension():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.int64)
    b = np.array([9, 1, 2, 3, 4, 0, 6, 7, 8], np.int64)
    assert overlap.chain([(1, 2), (5, 6), (6, 1)]) == [(1, 2), (5, 6)]
    assert overlap.extend(a, b, [(1, 2), (5, 6)]) == [(0, 1, 4), (5, 6, 3)]


def test_winnowing_keeps_shared_runs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 50, S.RUN + overlap.WINDOW - 1).astype(np.uint64)
        sides = [np.concatenate([rng.integers(50, 99, 20).astype(np.uint64), run, rng.integers(50, 99, 9).astype(np.uint64)]) for _ in range(2)]
        marks = []
        with np.errstate(over="ignore"):
            for h in sides:
                values = S.rolling(S.mix(h + np.uint64(1)), S.RUN)
                marks.append(set(values[S.winnow(values, overlap.WINDOW)].tolist()))
        assert marks[0] & marks[1]


def test_alignment_gives_no_more_than_the_similarity():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = S.mix(rng.integers(0, 40, 60).astype(np.uint64) + np.uint64(1))
        b = np.concatenate([a[20:50], a[:20]]) if rng.integers(2) else np.delete(a, rng.integers(0, 60, 5))
        with np.errstate(over="ignore"):
            true = S.similarity(S.shingle_set(a), S.shingle_set(b))
            alike, words = overlap.aligned(overlap.Text(a), overlap.Text(b), 0.5)
        assert alike <= true + 1e-12 and (alike >= 0.5) == (true >= 0.5) and words <= len(b)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_bands_follow_the_threshold(threshold):
    m, depth = neardup.bands(threshold)
    assert m <= neardup.MOST_BANDS and (1 - (1 - threshold**depth) ** m) ** 2 >= 1 - neardup.MISS


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_pairs_at_other_thresholds(spark, threshold):
    rng, texts = random.Random(4), []
    for k in range(150):
        base = [f"w{k}x{i}" for i in range(60)]
        edited = [f"e{k}x{i}" if i in set(rng.sample(range(60), (9 if threshold < 0.5 else 2))) else w for i, w in enumerate(base)]
        texts += [(f"a{k:03}", " ".join(base)), (f"b{k:03}", " ".join(edited))]
    sets = {k: frozenset(zip(w := S.words(t), w[1:], w[2:])) for k, t in texts}
    want = {(f"a{k:03}", f"b{k:03}") for k in range(150) if len(sets[f"a{k:03}"] & sets[f"b{k:03}"]) >= threshold * len(sets[f"a{k:03}"] | sets[f"b{k:03}"])}
    got = {(r.a, r.b) for r in neardup.near_pairs(spark.createDataFrame(texts, "id string, body string"), "id", "body", threshold).collect()}
    assert len(want) > 20 and not got - want and len(want - got) <= 0.01 * len(want)


def test_photo_pairs(spark):
    paths = ["raw/train/a1b2c3d4e-1.jpg", "raw\\test\\A1B2C3D4E_01 (2).JPG", "raw/test/batch_1/IMG-a1b2c3d4e-1-copy.png", "raw/test/a1b2c3d4e-2.jpg", "raw/train/note.jpg", None]
    df = spark.createDataFrame([(p, 1) for p in paths + paths[:2]], "path string, folder int")
    assert {tuple(r) for r in overlap.photo_pairs(df).collect()} == {(paths[0], paths[1]), (paths[0], paths[2])}


def test_report_and_coverage(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = " ".join("x" if k == 30 else f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    train = spark.createDataFrame([("A", base, "s1"), ("A", base, "s1"), ("b", other, None), ("c", None, "s1"), (None, base, "s1")], "PetID string, Description string, source string")
    test = spark.createDataFrame([("d", near, "s2"), ("e", base, "s2"), ("f", "short", "s2")], "PetID string, Description string, source string")
    index = spark.createDataFrame([("raw/train/x/a1-1.jpg",), ("raw/test/y/A1_1.jpg",), ("raw/test/y/a2-1.jpg",), (None,)], "path string")
    got = {(r.split, r.petid.lstrip("0")): (r.source, r.n_partners, round(r.cover, 3)) for r in overlap.coverage(train, test).collect()}
    assert got == {("train", "a"): ("s1", 2, 1.0), ("test", "d"): ("s2", 1, round(59 / 60, 3)), ("test", "e"): ("s2", 1, 1.0)}
    table = {(r.kind, r.split, r.source): (r.n_records, r.n_overlapping) for r in overlap.report(train, test, index).collect()}
    assert table == {("text", "train", "s1"): (1, 1), ("text", "train", None): (1, 0), ("text", "test", "s2"): (2, 2), ("photo", "train", "x"): (1, 1), ("photo", "test", "y"): (2, 1)}
    assert overlap.coverage(train.limit(0), test).count() == 0

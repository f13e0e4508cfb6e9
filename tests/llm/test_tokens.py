import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordinalis.llm import encode, mixing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "中", "1", "23", "!", "?!", "\xa0", "😀", "'", " the", "<|endoftext|>", "\x1c", "\x85", "\u2028", "\r\n", "\u3000"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.integers(1, 20))
def test_tree_equals_the_plain_encoding(reference, text, leaf):
    ids = encode.encode(text, leaf=leaf)
    assert ids == reference(text) and encode.decode(ids) == text


@pytest.mark.parametrize("text", [" " * 9000 + "x", "ab" * 20_000, "word " * 20_000, "\n" * 9001])
def test_long_texts(reference, text):
    assert encode.encode(text) == reference(text)


def test_document_ids(spark):
    rows = spark.createDataFrame([(1, "a cat", 1), (2, None, 2), (3, "", 3), (4, " ", 4)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.document_ids(rows).collect()}
    assert got[2] == [] and got[3] == [] and encode.decode(got[1]) == "a cat" and encode.decode(got[4]) == " "
    assert encode.document_ids(rows.limit(0)).count() == 0


def test_permutation_and_shards():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345)) == list(range(n))
    slots = np.array([500, 0, 37, 1200])
    parts = [mixing.shard_counts(slots, k, 100, 8) for k in range(18)]
    assert (sum(own for _, own in parts) == slots).all()
    for (before, own), (after, _) in zip(parts, parts[1:]):
        assert (before + own == after).all()


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["cat", "dog", "sat", "ran"]) for _ in range(rng.randint(5, 60))) + f" {k}", "abc"[min(k % 7, 2)]) for k in range(400)]
    rows += [(1000, rows[0][1], "b"), (1001, None, "a"), (1002, "", "a"), (1003, "lost", None), (1004, "unknown source", "q"), (1005, "long " * 30_000, "c")]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, ids string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    blocks = mixing.pack(documents, targets, block=32).toPandas()
    for source, part in blocks.groupby("source"):
        texts = {t for k, t, s in rows if s == source and t}
        if source == "b":
            texts -= {rows[0][1]}
        assert sum(map(len, part["ids"])) == sum(len(encode.encode(t)) for t in texts)
        assert (part.sort_values("block_no")["ids"].map(len).iloc[:-1] == 32).all()
    mixture, shares = mixing.mix(documents, targets, block=32, shard=16)
    got, report = mixture.toPandas(), shares.toPandas().set_index("source")
    uses = got.groupby(["source", "block_no"]).size().groupby("source").max()
    assert uses["a"] <= 3 and uses["b"] <= 2 and uses["c"] <= 1 and report.loc["none", "mixed_tokens"] == 0
    assert abs(report["actual_share"].sum() - 1) < 1e-9
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report.loc[s, "actual_share"] - share) < 0.02
    assert not got.duplicated(["shard", "slot"]).any()
    assert mixing.mix(documents.limit(0), targets)[0].count() == 0


def test_quotas_respect_caps():
    plan = mixing.quotas(pd.DataFrame({"source": ["a", "b"], "target_share": [0.9, 0.1], "max_repeats": [1, 5]}), {"a": (10, 100), "b": (10, 100)})
    assert dict(zip(plan["source"], plan["slots"])) == {"a": 10, "b": 1}


def test_a_small_source_bounds_only_its_own_share():
    targets = pd.DataFrame({"source": ["a", "b"], "target_share": [0.95, 0.05], "max_repeats": [2, 2]})
    sizes = {"a": (1000, 10_000), "b": (1, 10)}
    slots = lambda **p: dict(zip(*mixing.quotas(targets, sizes, **p)[["source", "slots"]].to_numpy().T, strict=True))
    assert slots() == {"a": 38, "b": 2} and slots(total=10_000) == {"a": 950, "b": 2} and slots(total=10**9) == {"a": 2000, "b": 2}


def test_large_draws_are_hypergeometric():
    counts = np.array([400_000_000, 500_000_000, 0, 100_000_000])
    drawn = np.array([mixing.hypergeometric(counts, 300_000_000, k) for k in range(60)])
    assert (drawn.sum(axis=1) == 300_000_000).all() and (drawn <= counts).all() and not drawn[:, 2].any()
    share = counts / counts.sum()
    sd = np.sqrt(300_000_000 * share * (1 - share) * 0.7)[[0, 1, 3]]
    z = (drawn - 300_000_000 * share)[:, [0, 1, 3]] / sd
    assert (abs(z.mean(axis=0)) < 0.6).all() and ((z.std(axis=0) > 0.7) & (z.std(axis=0) < 1.3)).all()
    small = [mixing._large_marginal(5, 7, 6, u) for u in (np.arange(2000) + 0.5) / 2000]
    want = np.random.default_rng(1).hypergeometric(5, 7, 6, 200_000)
    assert np.bincount(small, minlength=6) / 2000 == pytest.approx(np.bincount(want, minlength=6) / 200_000, abs=0.005)
    slots = np.array([1_500_000_000, 7, 900_000_000])
    first, second = (mixing.shard_counts(slots, k, 10**9, 8) for k in (0, 1))
    assert first[1].sum() == 10**9 and (first[0] + first[1] == second[0]).all()

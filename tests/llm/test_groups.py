import random

import numpy as np
import pytest

from ordinalis.llm.groups import match_groups
from ordinalis.llm.hooking import connected_components, roots

SCHEMA = "pair_kind string, key_a string, key_b string, score double, is_match boolean, node string, component string"


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape, hot_rows):
    rng = random.Random(5)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 3), (4, None), (5, 5)],
        "chain": [(k, k + 1) for k in range(64)] + [(k + 1, k) for k in range(10)],
        "star": [(999, k) for k in range(120)],
        "none": [(7, 7), (None, None)],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a int, b int"), hot_rows=hot_rows).collect()}
    assert got == brute(links)


def test_match_groups(spark):
    rows = [
        ("pet", "0000A1B2C", "a1b2d", 0.1, True), ("pet", "a1b2d", "0000a1b2c", 0.9, True), ("pet", "a1b2d", "ffffffff0", 0.2, True),
        ("pet", "x", "y", 0.9, False), ("pet", "x", "z", 0.9, None), ("pet", None, "q", 1.0, True), ("pet", "q", "q", 1.0, True),
        ("photo", "raw/B.jpg", "raw/a.jpg", 0.5, True), ("photo", "0000a1b2c", "raw/B.jpg", 0.5, True), (None, "m", "n", 1.0, True), ("other", "m", "n", 1.0, True),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {(r.kind, r.rec_key): r.group_key for r in match_groups(df).collect()}
    assert got == {
        ("pet", "0000a1b2c"): "0000a1b2c", ("pet", "0000a1b2d"): "0000a1b2c", ("pet", "ffffffff0"): "0000a1b2c",
        ("photo", "raw/B.jpg"): "0000a1b2c", ("photo", "raw/a.jpg"): "0000a1b2c", ("photo", "0000a1b2c"): "0000a1b2c",
    }
    assert match_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 100, 10**9])
def test_one_task_finishes_what_fits(spark, few):
    rng = random.Random(6)
    links = [(f"k{rng.randrange(300)}é", f"k{rng.randrange(300)}é") for _ in range(220)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)]
    df = spark.createDataFrame(links, "a string, b string")
    got = {r.node: r.component for r in connected_components(df, few=few).collect()}
    assert got == brute(links)


def test_few_links_take_few_jobs(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)], "a int, b int")
    spark.sparkContext.setJobGroup("few links", "")
    assert {r.component for r in connected_components(df).collect()} == {0}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10


def test_roots_of_a_long_chain():
    order = np.random.default_rng(3).permutation(5000)
    assert not roots(order[:-1], order[1:], 5001)[:5000].any() and roots(order[:-1], order[1:], 5001)[5000] == 5000

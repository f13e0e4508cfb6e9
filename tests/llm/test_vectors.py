import numpy as np

from ordinalis.llm.vecsearch import Cells, chi_square_quantile, nearest


def test_quantile():
    assert abs(chi_square_quantile(2, 0.95) - 5.991) < 1e-3 and abs(chi_square_quantile(8, 0.99) - 20.090) < 1e-3


def test_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 24)) * 0.6
    x *= rng.uniform(0.4, 2.5, size=(1200, 1))
    rows = [(f"p{k:04}", [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [("null", None), ("zero", [0.0] * 24), ("nan", [float("nan")] * 24), ("inf", [float("inf")] * 24), ("short", [1.0]), ("empty", []), (None, [1.0] * 24), ("p0000", rows[0][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd], "path string, vector array<float>, cosine string")
    asked = [f"p{k:04}" for k in range(0, 1200, 20)] + ["null", "zero", "nan", "absent"]
    queries = spark.createDataFrame([(q,) for q in asked + asked[:2]], "path string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block, sample in ((100, 300), (65536, 8192), (400, 4)):
        got = {}
        for r in nearest(df, queries, "path", "vector", 5, block=block, sample=sample).collect():
            got.setdefault(r.query, set()).add(r.near)
        assert set(got) == set(asked[:60]) and all(len(v) == 5 for v in got.values())
        right = 0
        for q, near in got.items():
            s = u @ u[int(q[1:])]
            s[int(q[1:])] = -9
            right += len(near & {f"p{k:04}" for k in np.argsort(-s)[:5]})
        assert right >= 0.9 * 300
    assert nearest(df.limit(0), queries, "path", "vector", 5).count() == 0 and nearest(df, queries.limit(0), "path", "vector", 5).count() == 0


def test_fewer_than_k_and_ties(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("a", [1.0, 0.0])], "path string, v array<float>")
    assert [(r.near) for r in nearest(df, df.where("path = 'b'"), "path", "v", 5).orderBy("near").collect()] == ["a", "c"]
    assert [r.near for r in nearest(df, df.where("path = 'b'"), "path", "v", 1).collect()] == ["a"]


def test_repeated_rows_and_copies(spark):
    rng = np.random.default_rng(9)
    x = {f"p{k:03}": rng.integers(-9, 10, 16).astype(float) for k in range(90)}
    x |= {f"c{k:03}": np.arange(16.0) for k in range(600)}  # copies, more than a leaf holds
    u = {p: v / np.linalg.norm(v) for p, v in x.items()}
    rows = [(p, v.tolist()) for p, v in reversed(x.items())]
    near = sorted(u, key=lambda p: -float(u[p] @ u["p000"]))[:6]
    rows += [(p, x[p].tolist()) for p in near for _ in range(15)] + [("p001", x["p001"].tolist())] * 400
    df = spark.createDataFrame(rows, "path string, v array<float>")
    asked = [*[f"p{k:03}" for k in range(12)], "c000", "c300", "c599"]
    want = {}
    for q in asked:
        best = sorted((-round(float(u[q] @ v), 9), p) for p, v in u.items() if p != q)[:5]
        want[q] = {p for _, p in best}
    for block, leaf in ((65536, 128), (65536, 4096), (300, 4096)):
        got = {}
        for r in nearest(df.coalesce(1), spark.createDataFrame([(q,) for q in asked], "path string"), "path", "v", 5, block=block, leaf=leaf, miss=1e-9).collect():
            got.setdefault(r.query, set()).add(r.near)
        assert got == want


def test_every_vector_is_a_query(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in nearest(df, df, "id", "v", 5, block=256, sample=500).collect():
        got.setdefault(r.query, set()).add(r.near)
    score = u @ u.T
    np.fill_diagonal(score, -2)
    want = np.argsort(-score, axis=1)[:, :5]
    assert len(got) == 2000 and sum(len(got[k] & set(want[k].tolist())) for k in range(2000)) >= 0.9 * 10_000


def test_cells_hold_every_row_and_split_heavy_ones():
    rng = np.random.default_rng(2)
    low = np.concatenate([rng.normal(size=(3000, 4)), np.zeros((1500, 4))])
    cells = Cells(low, 8, 450_000, 50_000)
    cell = cells.of(low)
    assert ((low >= cells.floor[cell]) & (low <= cells.ceil[cell])).all() and cells.blocks[cells.of(np.zeros((1, 4)))[0]] >= 2
    assert cells.blocks.sum() < 20 and (cells.first == np.cumsum(cells.blocks) - cells.blocks).all()
    query, reached = cells.reached(low[:50], np.full(50, 1e-9), 9.0)
    assert {(q, c) for q, c in zip(range(50), cell[:50])} <= set(zip(query.tolist(), reached.tolist()))

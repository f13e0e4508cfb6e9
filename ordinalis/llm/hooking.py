"""Connected components by deterministic Borůvka hooking.

Every component hooks onto its smallest neighbour, the resulting trees collapse by pointer doubling, the edges are relabelled and
deduplicated, and this repeats until no edge is left. If each vertex points to its smallest neighbour, two steps along the pointers
never increase the vertex, and the only cycles are pairs; so the smaller vertex of a tree's one pair is the smallest of the whole
tree, and the labels need no later correction. The number of live components halves at least in every round. Once so few edges
are left that they fit into one task's memory, that task does the remaining rounds by itself: each of them would cost the driver a dozen
jobs and the disk several copies of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.operators.lookup import HOT_ROWS, lookup
from ordinalis.session import cut


#: Edges up to which one task takes them all; it holds about 150 bytes for each.
FEW = 3_000_000
#: Rows of a batch that this task gives back.
BATCH = 100_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of the ``n`` vertices, by the same rounds: every root hooks onto a smaller one."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        live = a != b
        if not live.any():
            return parent
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def _finish(edges: DataFrame) -> DataFrame:
    """(node, parent): every vertex of ``edges`` with the root of its component. One task joins the vertices, known to it by 128 bits of
    hashes; their names, which may be long, stay with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if not sum(map(len, parts)):
            return
        ends = np.concatenate(parts)
        del parts
        m, ends = len(ends), np.concatenate([ends[:, :2], ends[:, 2:]])
        order = np.lexsort((ends[:, 1], ends[:, 0]))
        ends = ends[order]
        new = np.concatenate([[True], (ends[1:] != ends[:-1]).any(axis=1)])
        code = np.empty(2 * m, np.int32)
        code[order] = np.cumsum(new) - 1
        del order
        ends = ends[new]
        root = roots(code[:m], code[m:], len(ends))
        for k in range(0, len(ends), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (ends[k : k + BATCH, 0], ends[k : k + BATCH, 1], root[k : k + BATCH])], ["h", "g", "root"])

    hashes = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
    found = edges.select(*hashes("lo"), *hashes("hi")).coalesce(1).mapInArrow(run, "h long, g long, root long")
    h, g = hashes("node")
    named = edges.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy(h.alias("h"), g.alias("g")).agg(F.min("node").alias("node"))
    return named.join(found.hint("merge"), ["h", "g"]).select("node", F.min("node").over(W.partitionBy("root")).alias("parent"))


def _hook(edges: DataFrame) -> DataFrame:
    """(node, parent): the smallest neighbour, or the node itself where two point at each other and it is the smaller."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.min("e.other").alias("parent"))


def _double(tree: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """Every pointer moves to where its target points."""
    step = lookup(tree, "parent", tree.select("node", F.col("parent").alias("up")), "node", n, hot_rows=hot_rows)
    return step.select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved"))


def _collapse(hooks: DataFrame, n: int, hot_rows: int) -> tuple[DataFrame, int]:
    """Pointer doubling, two steps to each materialisation, until every node points at its root; and the number of nodes."""
    keep = cut if n >= hot_rows else lambda df: df  # hot keys are read several times
    hooks = keep(hooks)
    step = lookup(hooks, "parent", hooks.select("node", F.col("parent").alias("up")), "node", n, hot_rows=hot_rows)
    tree = keep(step.select("node", F.when((F.col("up") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent")))
    while True:
        tree = cut(_double(keep(_double(tree, n, hot_rows)), n, hot_rows))
        nodes, moved = tree.agg(F.count("*"), F.max("moved")).first()
        if not moved:
            return tree.select("node", "parent"), nodes


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, hot_rows: int = HOT_ROWS, few: int | None = None) -> DataFrame:
    """(node, component) of every node that has a link to another node; component is the smallest node of the group.

    Order and repeats of links do not matter. Links with a null end and links of a node to itself are no links. Other columns of
    ``links`` are ignored. An empty input gives an empty result. Up to ``few`` edges are finished in one task; by default that is FEW, and
    none where ``hot_rows`` asks for split lookups of fewer rows.
    """
    few = (FEW if hot_rows >= HOT_ROWS else 0) if few is None else few
    edges = cut(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y and lo <> hi").select("lo", "hi").distinct())
    empty = edges.select(F.col("lo").alias("node"), F.col("hi").alias("component")).limit(0)
    levels: list[tuple[DataFrame, int]] = []
    while m := edges.count():
        if m <= few:
            levels.append((_finish(edges), 2 * m))
            break
        keep = cut if m >= hot_rows else lambda df: df
        tree, n = _collapse(_hook(edges), 2 * m, hot_rows)
        levels.append((tree, n))
        half = keep(lookup(edges, "lo", tree.select("node", F.col("parent").alias("lo_root")), "node", m, hot_rows=hot_rows).select("lo_root", "hi"))
        both = lookup(half, "hi", tree.select("node", F.col("parent").alias("hi_root")), "node", m, hot_rows=hot_rows)
        edges = cut(both.select(F.least("lo_root", "hi_root").alias("lo"), F.greatest("lo_root", "hi_root").alias("hi")).where("lo <> hi").distinct())
    if not levels:
        return empty
    # The levels shrink geometrically: composing from the last to the first touches each node a bounded number of times.
    whole, _ = levels.pop()
    while levels:
        tree, n = levels.pop()
        step = lookup(tree, "parent", whole.select("node", F.col("parent").alias("up")), "node", n, hot_rows=hot_rows)
        whole = step.select("node", F.coalesce("up", "parent").alias("parent"))
        if levels:
            whole = cut(whole)
    return whole.select("node", F.col("parent").alias("component"))

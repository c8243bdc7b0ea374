"""Connected components of a graph given as a table of links: within blocks of links first, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lean, written_at

#: Rounds of stars, and links that a task holds at a time.
MOST_ROUNDS, BLOCK_LINKS = 60, 1_000_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of some links that aren't their component's least: pointers jump to lesser neighbours until none moves."""
    nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        least = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(least, root[a], low)
        np.minimum.at(least, root[b], low)
        while (least[least] != least).any():
            least = least[least]
        new = least[root]
        if (new == root).all():
            far = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[far], nodes[root[far]]
        root = new


def in_blocks(links: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """Links (u, v) that connect the same nodes as ``links`` do, at most one for each node and block: what a task sees is joined there at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> pa.RecordBatch:
            a, b = local_stars(*(np.concatenate([x[side] for x in held]) for side in (0, 1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) >= block:
                yield joined()
        if held:
            yield joined()

    return links.mapInArrow(lean(run), "u long, v long")


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and u's neighbours; a hub's join partition is one that AQE can split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the component's least node) for every node that has a link to another.

    ``links`` may repeat pairs and hold loops or nulls, which don't count. Each round writes its edges to the shared folder, so the
    plan doesn't grow and lost executors cost one round, and deletes those of the round before; the number of rounds grows with the logarithm of a component's length.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = in_blocks(edges).distinct()
    (edges, path), before = written_at(edges, "links"), None
    for _ in range(MOST_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _with_least(down)
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(starred.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        edges, new_path = written_at(small, "stars")
        discard(edges.sparkSession, [path])
        path = new_path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())

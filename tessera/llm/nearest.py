"""Exact top-k search by inner product, as a Voronoi join.

Vectors become whole numbers. A few of them serve as pivots, and every vector belongs to the cell of its nearest pivot. Each query first meets one block of
its own cell's vectors: the k-th best score there is a floor that its k-th best of all can't lie below. The queries of a cell are then summed up by the least
floor, the radius, the greatest norm and the greatest product with each pivot. Cells are put together into groups of as many queries as a task
holds, and a vector is sent, once, to a group only if a bound on its product with the queries of one of its cells reaches that cell's floor.
It carries the cells that need it, and there the queries of a cell are multiplied with the vectors of the block that need to meet this cell alone; what
reaches a query's floor is ranked once more. The bounds are safe, so results are exact whatever the pivots are.

Blocks have a bounded size, whatever a cell's share of the rows. On the driver are pivots and summaries, of at most MOST_PIVOTS cells.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; every other vector does, and a score of the
result that leaves a long, or a component of 2^200 or more, raises an error; a shorter vector counts as padded with zeros; equal scores go to the
smaller id, then either row; a query's own row is left out, another row with its id is not; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table, written

#: Queries for each pivot and the most pivots; the most queries of a group, vectors of a block, and queries whose scores are held at a time.
PIVOT_QUERIES, MOST_PIVOTS, GROUP_QUERIES, DATA_BLOCK, TILE = 8, 256, 16_384, 16_384, 128
#: Vectors of a block at least, while there are fewer blocks than partitions.
LEAST_BLOCK = 512
SCALE, TOO_LARGE, LONG = 256, 2.0**200, 1 << 63
NO_FLOOR = -LONG


def unpacked(rows: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in double precision where that holds every sum, else in 64-bit integers, else in Python's."""
    big = np.abs(a).max(axis=1, initial=0) >= 2**24
    if big.any() and not big.all():  # large queries don't slow the others
        rest = products(a[~big], b)
        out = np.empty((len(a), len(b)), dtype=object)
        out[~big], out[big] = rest, products(a[big], b)
        return out
    reach = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(axis=1, initial=0) + 1) * max(1, a.shape[1])
    fast, slow = reach < 2**52, reach >= 2**62
    if fast.all():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=object if slow.any() else np.int64)
    out[:, fast] = (a @ b[fast].T).astype(np.int64)
    middle = ~fast & ~slow
    out[:, middle] = a.astype(np.int64) @ b[middle].astype(np.int64).T if middle.any() else 0
    whole = [[int(x) for x in row] for row in a] if slow.any() else []
    for j in np.flatnonzero(slow):
        v = [int(x) for x in b[j]]
        out[:, j] = [sum(x * y for x, y in zip(row, v, strict=True)) for row in whole]
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query, by score and then by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def usable(embedding: str) -> Column:
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return e.isNotNull() & F.coalesce(fine, F.lit(False))


def voronoi_join(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", group_queries: int = GROUP_QUERIES, data_block: int = DATA_BLOCK, pivot_queries: int = PIVOT_QUERIES, made: Accumulator | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest integer inner product for every row that ``is_query`` names. ``made`` adds up how many products were worked out behind the floors."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector_col).alias("v"))
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.count_if("query")).first()
    n, width, top, queries = facts[0], facts[1] or 0, facts[2] or 0.0, facts[3]
    if not n or not queries:
        return spark.createDataFrame([], result)
    if top >= TOO_LARGE:
        raise ValueError(f"a component of {top} makes scores that leave a long")
    kind = "<i2" if top * SCALE < 2**15 - 2 else "<i4" if top * SCALE < 2**31 - 2 else "<f8"

    def whole(v: pd.Series) -> np.ndarray:
        out = np.zeros((len(v), width), dtype=np.float64)
        for i, x in enumerate(v):
            out[i, : len(x)] = np.floor(SCALE * np.asarray(x, dtype=np.float64))
        return out

    count = max(1, min(MOST_PIVOTS, n, max(4, queries // pivot_queries)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("v").collect()
    pivots = whole(pd.Series([r["v"] for r in chosen]))
    squares = (pivots * pivots).sum(axis=1)
    lengths = np.sqrt(squares)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = whole(batch["v"])
            cell = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
            distance = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "query": batch["query"], "cell": cell, "distance": distance, "x": [r.tobytes() for r in x.astype(kind)]})

    placed = rows.mapInPandas(assign, "vec_id long, query boolean, cell int, distance double, x binary")
    placed = written(placed.withColumn("uid", F.monotonically_increasing_id()), "cells")
    floors = own_cell_floors(placed, k, kind, width, group_queries, data_block)
    asked = placed.where("query").drop("query").join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
    asked = written(asked, "queries")

    def summed_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = unpacked(batch["x"], kind, width)
                norm, to_pivots = np.sqrt((q * q).sum(axis=1)), q @ pivots.T
                floor = np.where(batch["floor"] == NO_FLOOR, -np.inf, batch["floor"].astype("float64"))
                for cell in np.unique(batch["cell"]):
                    own = (batch["cell"] == cell).to_numpy()
                    yield pd.DataFrame({"cell": cell, "pivot": np.arange(len(pivots)), "n": int(own.sum()), "floor": floor[own].min(), "radius": batch["distance"][own].max(), "norm": norm[own].max(), "most": to_pivots[own].max(axis=0)})

    parts = asked.select("cell", "distance", "floor", "x").mapInPandas(summed_up, "cell int, pivot int, n long, floor double, radius double, norm double, most double")
    cells = parts.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("floor").alias("floor"), F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.max("most").alias("most")).toPandas()
    cells = cells.sort_values(["cell", "pivot"])
    heads = cells[cells["pivot"] == 0]
    numbers = heads["cell"].to_numpy()
    floor, radius, norm, size = (heads[c].to_numpy() for c in ("floor", "radius", "norm", "n"))
    most = cells["most"].to_numpy().reshape(len(numbers), len(pivots))
    groups = grouped(size, group_queries)
    member = np.zeros((len(numbers), max(max(g) for g in groups) + 1), dtype=bool)
    for c, own in enumerate(groups):
        member[c, own] = True
    data_blocks = max(1, -(-n // data_block), min(-(-n // LEAST_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = unpacked(batch["x"], kind, width)
            long = np.sqrt((x * x).sum(axis=1))[:, None]
            by_queries = x @ pivots[numbers].T + long * radius
            by_pivot = most[:, batch["cell"]].T + norm * batch["distance"].to_numpy()[:, None]
            # a margin for what double precision may lose
            lost = 1e-9 * (long * (lengths[numbers] + radius) + norm * (lengths[batch["cell"]] + batch["distance"].to_numpy())[:, None]) + 1e-3
            needed = np.minimum(by_queries, by_pivot) + lost >= floor
            at, to = np.nonzero(needed @ member)
            cells = [r.tobytes() for r in np.packbits(needed, axis=1)]
            yield pd.DataFrame({"part": to, "db": batch["db"].to_numpy()[at], "uid": batch["uid"].to_numpy()[at], "vec_id": batch["vec_id"].to_numpy()[at], "x": batch["x"].to_numpy()[at], "cells": [cells[i] for i in at]})

    block_of = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(data_blocks)).cast("int")
    data = placed.select("cell", "distance", "uid", "vec_id", "x", block_of.alias("db")).mapInPandas(send, "part int, db int, uid long, vec_id long, x binary, cells binary")
    parts_of = F.element_at(F.create_map(*[y for c, own in zip(numbers, groups, strict=True) for y in (F.lit(int(c)), F.array(*map(F.lit, own)))]), F.col("cell"))
    asked = asked.withColumn("__of", parts_of).withColumn("part", F.element_at("__of", (F.pmod(F.xxhash64("uid", F.lit(2)), F.size("__of")) + 1).cast("int")))
    asked = asked.select("part", "cell", "uid", "vec_id", "floor", "x", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("db"))

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found, octets = [], -(-len(numbers) // 8)
        needs = np.unpackbits(np.frombuffer(b"".join(d["cells"]), dtype=np.uint8).reshape(len(d), octets), axis=1).astype(bool)
        for cell, own in q.groupby("cell"):
            near = d[needs[:, np.searchsorted(numbers, cell)]]
            if made is not None:
                made.add(len(own) * len(near))
            found += [(uid, query, i, in_long(s), u) for uid, query, i, s, u in met(own, near, k, kind, width)]
        return pd.DataFrame(found, columns=["quid", "query_id", "vec_id", "score", "uid"], dtype="int64")

    found = asked.groupBy("part", "db").cogroup(data.groupBy("part", "db")).applyInPandas(meet, "quid long, query_id long, vec_id long, score long, uid long")
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(q: pd.DataFrame, d: pd.DataFrame, k: int, kind: str, width: int) -> Iterator[tuple]:
    """(the query's uid and id, a vector's id, the score, its uid) of the k best of ``d`` for each query, as far as they reach its floor."""
    if not len(q) or not len(d):
        return
    x, ids, uids = unpacked(d["x"], kind, width), d["vec_id"].to_numpy(), d["uid"].to_numpy()
    for at in range(0, len(q), TILE):
        tile = q.iloc[at : at + TILE]
        scores = products(unpacked(tile["x"], kind, width), x)
        for r, (uid, query, floor) in enumerate(zip(tile["uid"], tile["vec_id"], tile["floor"], strict=True)):
            others = np.flatnonzero(uids != uid) if floor == NO_FLOOR else np.flatnonzero((uids != uid) & (scores[r] >= floor))
            best = others[best_rows(scores[r, others], ids[others], k)]
            yield from zip([uid] * len(best), [query] * len(best), ids[best].tolist(), scores[r, best].tolist(), uids[best].tolist(), strict=True)


def in_long(score: int) -> int:
    if not -LONG <= score < LONG:
        raise OverflowError(f"the score {score} leaves a long")
    return score


def own_cell_floors(placed: DataFrame, k: int, kind: str, width: int, group_queries: int, data_block: int) -> DataFrame:
    """uid and floor, the k-th best score of each query among one block of its own cell's vectors; a query that meets fewer has no row."""
    sizes = {r["cell"]: (r["n"], r["queries"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("queries")).collect()}
    lookup = lambda values: F.element_at(F.create_map(*[F.lit(int(x)) for pair in values.items() for x in pair]), F.col("cell"))
    share, parts = lookup({c: max(1, math.ceil(n / data_block)) for c, (n, _) in sizes.items()}), lookup({c: max(1, math.ceil(q / group_queries)) for c, (_, q) in sizes.items()})
    few = placed.where(F.pmod(F.xxhash64("uid", F.lit(3)), share) == 0).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", "part", "uid", "vec_id", "x")
    asked = placed.where("query").select("cell", F.pmod(F.xxhash64("uid", F.lit(2)), parts).cast("int").alias("part"), "uid", "vec_id", "x")

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        scores: dict[int, list[int]] = {}
        for uid, _, _, score, _ in met(q.assign(floor=NO_FLOOR), d, k, kind, width):
            scores.setdefault(uid, []).append(score)
        found = [(uid, max(NO_FLOOR, min(LONG - 1, min(s)))) for uid, s in scores.items() if len(s) == k]
        return pd.DataFrame(found, columns=["uid", "floor"], dtype="int64")

    return asked.groupBy("cell", "part").cogroup(few.groupBy("cell", "part")).applyInPandas(best, "uid long, floor long")


def grouped(sizes: np.ndarray, most: int) -> list[list[int]]:
    """For each cell of so many queries the groups that hold them: small cells share one, a larger one has several for itself."""
    out, made, shared, held = [], 0, None, 0
    for n in sizes.tolist():
        count = max(1, -(-n // most))
        if count == 1 and shared is not None and held + n <= most:
            out.append([shared])
            held += n
            continue
        out.append(list(range(made, made + count)))
        if count == 1:
            shared, held = made, n
        made += count
    return out


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_sql() -> str:
    return """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """

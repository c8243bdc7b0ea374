"""Views that give the driver's ``embeddings`` table the shapes of patch data, and the same views in DuckDB's SQL.

Each patch is a vector: ten slides, a grid of eight columns, a binary label, and three encoders that see parts of the vector and lack some rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 512
#: slice start and length, the remainder of vec_id % 17 that is missing, by encoder
ENCODERS = {"a": (1, 16, 1), "b": (17, 24, 2), "c": (41, 24, 3)}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.selectExpr(
        "vec_id", "concat('S', vec_id % 10) AS slide_id", "vec_id div 10 AS row_idx", f"CAST((vec_id div 10) % 8 * {TILE} AS DOUBLE) AS x",
        f"CAST((vec_id div 10) div 8 * {TILE} AS DOUBLE) AS y", "CAST(label < 3 AS INT) AS label", "embedding AS e",
    )


def encoder(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    start, length, gone = ENCODERS[name]
    rows = base(spark, sf_dir).where(f"vec_id % 17 <> {gone}")
    label = F.expr("if(vec_id % 13 = 0, 1 - label, label)") if name == "b" else F.col("label")
    return rows.select("vec_id", "slide_id", "row_idx", "x", "y", F.slice("e", start, length).alias("features"), label.alias("label"))


def total(array: str, start: int = 1, length: int = 64):
    return F.expr(f"aggregate(slice({array}, {start}, {length}), 0D, (a, v) -> a + v)")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_a, p_b, p_c, p_deep of every base row, by a fixed linear scorer."""
    rows = base(spark, sf_dir)
    p = {n: 1 / (1 + F.exp(-4 * total("e", *ENCODERS[n][:2]))) for n in ENCODERS} | {"deep": 1 / (1 + F.exp(-4 * total("e")))}
    return rows.select("vec_id", "slide_id", "row_idx", "x", "y", "label", *[v.alias(f"p_{k}") for k, v in p.items()])


def nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of nine sources: each lacks some rows and has some labels flipped."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("source_id")
    rows = base(spark, sf_dir).select("*", ids).where("vec_id % 19 <> source_id")
    label = F.expr("if(vec_id % 11 = source_id, 1 - label, label)")
    return rows.select("source_id", "slide_id", "row_idx", "x", "y", label.alias("label"), "vec_id")


#: Corners of the polygon of each labelled patch, and how far its vector's components move them.
CORNERS, REACH = 5, 2000


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pentagon around each patch of label 1, its corners moved by the vector's components, so that some cross themselves; and the shapes below."""
    corners = ", ".join(f"named_struct('x', x + {REACH}D * CAST(e[{2 * i}] AS DOUBLE), 'y', y + {REACH}D * CAST(e[{2 * i + 1}] AS DOUBLE))" for i in range(CORNERS))
    rows = base(spark, sf_dir).where("label = 1").selectExpr("slide_id", f"array({corners}) AS vertices")
    fixed = [(s, [(float(a), float(b)) for a, b in v]) for s, v in SHAPES]
    return rows.unionAll(spark.createDataFrame(fixed, "slide_id string, vertices array<struct<x:double,y:double>>"))


#: touching a corner, touching an edge, a near miss, outside, inside one patch, around all, concave; then too few vertices and a bow tie
SHAPES = [
    ("S0", [(3072, 0), (3072, -100), (3150, -50)]),
    ("S4", [(4096, 0), (4200, 0), (4200, 300), (4096, 300)]),
    ("S5", [(4096.5, 0), (4200, 0), (4200, 300), (4096.5, 300)]),
    ("S6", [(5000, -300), (4060, -10), (5000, -5)]),
    ("S1", [(2600, 1600), (2700, 1600), (2700, 1700), (2600, 1700)]),
    ("S2", [(-10, -10), (5000, -10), (5000, 5000), (-10, 5000)]),
    ("S3", [(1500, 1500), (3500, 1500), (3500, 2900), (2500, 1900), (1500, 2900)]),
    ("S7", [(0, 0), (4000, 4000)]),
    ("S8", [(0, 0), (2000, 2000), (2000, 0), (0, 2000)]),
]


def maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two 8 by 8 maps of each tile in [0, 1]: the tile's own vector and that of 250 further on, the first after the last."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = "transform(e, v -> (CAST(v AS DOUBLE) - array_min(e)) / (CAST(array_max(e) AS DOUBLE) - array_min(e) + 1e-8D))"
    long = lambda rows: rows.selectExpr("tile_id", f"posexplode({unit}) AS (pix, v)")
    a = e.selectExpr("CAST(vec_id AS INT) AS tile_id", "embedding AS e")
    count = e.agg(F.count("*").alias("n"))
    b = e.crossJoin(F.broadcast(count)).selectExpr("CAST((vec_id + n - 250 % n) % n AS INT) AS tile_id", "embedding AS e")  # one row: a number
    return long(a), long(b)


def attention_heads(spark: SparkSession, sf_dir: str, tokens: int = 10) -> DataFrame:
    """Queries and keys of two heads, one number for each token: parts of the vector."""
    part = lambda at: ", ".join(f"slice(embedding, {32 * h + at + 1}, {tokens})" for h in (0, 1))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("CAST(vec_id AS INT) AS tile_id", f"concat({part(0)}) AS q", f"concat({part(10)}) AS k")


#: Width and height of the made-up slide pictures.
PICTURE = (160, 120)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of each slide of ``base``: channels run with x, y and the slide's number."""
    width, height = PICTURE

    @F.pandas_udf("binary")
    def paint(number: pd.Series) -> pd.Series:
        y, x, c = np.indices((height, width, 3))
        return pd.Series([((7 * x + 13 * y + 31 * n + 50 * c) % 256).astype(np.uint8).tobytes() for n in number])

    slides = base(spark, sf_dir).select("slide_id").distinct()
    return slides.select("slide_id", F.lit(width).alias("width"), F.lit(height).alias("height"), paint(F.expr("CAST(substring(slide_id, 2) AS INT)")).alias("pixels"))


#: Annotation files, one of them in a folder with a slide's name, and slide images, some of other formats.
PATHS = [f"/ann/S{s}_v{v}.tumor.xml" for s in range(9) for v in (0, 1)] + ["/S9/other.tumor.xml"]
IMAGES = [f"S{s}.svs" for s in range(6)] + [f"S{s}_extra.tif" for s in range(8)] + ["S3.jpg", "S7_x.TIF", "S5.tiff", "S8.png", "S6.SVS"]


def annotation_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def slide_images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in IMAGES], "name string")


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.selectExpr("vec_id AS epoch", "round(abs(CAST(embedding[1] AS DOUBLE)), 1) AS acc", "abs(CAST(embedding[2] AS DOUBLE)) AS loss", "CAST(1 + vec_id % 3 AS BIGINT) AS n")


def _sql_polygons() -> str:
    rows = [f"SELECT {-1 - k} AS pid, '{s}' AS slide_id, {i} AS i, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y" for k, (s, v) in enumerate(SHAPES) for i, (a, b) in enumerate(v)]
    return " UNION ALL ".join(rows)


def _sum(start: int, length: int) -> str:
    return f"list_sum(list_transform(e[{start}:{start + length - 1}], lambda v: CAST(v AS DOUBLE)))"


def _sql_list(values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ")"


#: DuckDB's form of the views, in the order in which they build on each other.
SQL = {
    "base": f"""SELECT vec_id, 'S' || (vec_id % 10) AS slide_id, vec_id // 10 AS row_idx, CAST((vec_id // 10) % 8 * {TILE} AS DOUBLE) AS x,
        CAST((vec_id // 10) // 8 * {TILE} AS DOUBLE) AS y, CAST(label < 3 AS INTEGER) AS label, embedding AS e FROM embeddings""",
    **{
        f"enc_{n}": f"SELECT vec_id, slide_id, row_idx, x, y, e[{s}:{s + k - 1}] AS features, {'CASE WHEN vec_id % 13 = 0 THEN 1 - label ELSE label END' if n == 'b' else 'label'} AS label FROM base WHERE vec_id % 17 <> {gone}"
        for n, (s, k, gone) in ENCODERS.items()
    },
    "scores": "SELECT vec_id, slide_id, row_idx, x, y, label, "
    + ", ".join(f"1 / (1 + exp(-4 * {_sum(s, k)})) AS p_{n}" for n, (s, k, _) in ENCODERS.items())
    + f", 1 / (1 + exp(-4 * {_sum(1, 64)})) AS p_deep FROM base",
    "votes": """SELECT *, CAST(p_a >= 0.5 AS INTEGER) AS a, CAST(p_b >= 0.5 AS INTEGER) AS b, CAST(p_c >= 0.5 AS INTEGER) AS c, CAST(p_deep >= 0.5 AS INTEGER) AS deep,
        CAST((p_a + p_b + p_c) / 3 >= 0.5 AS INTEGER) AS soft,
        CAST(CAST(p_a >= 0.5 AS INTEGER) + CAST(p_b >= 0.5 AS INTEGER) + CAST(p_c >= 0.5 AS INTEGER) >= 2 AS INTEGER) AS hard FROM scores""",
    "nine": """SELECT s.source_id, slide_id, row_idx, x, y, CASE WHEN vec_id % 11 = s.source_id THEN 1 - label ELSE label END AS label, vec_id,
        slide_id || '|' || CAST(round_even(x, 0) AS BIGINT) || ',' || CAST(round_even(y, 0) AS BIGINT) AS key
        FROM base, (SELECT CAST(range AS INTEGER) AS source_id FROM range(9)) s WHERE vec_id % 19 <> s.source_id""",
    "vertices": f"""SELECT vec_id AS pid, slide_id, i, x + {REACH}::DOUBLE * CAST(e[2 * i + 1] AS DOUBLE) AS x, y + {REACH}::DOUBLE * CAST(e[2 * i + 2] AS DOUBLE) AS y
        FROM base, (SELECT range AS i FROM range({CORNERS})) WHERE label = 1 UNION ALL {_sql_polygons()}""",
    "edges": """SELECT v.pid, v.slide_id, v.i, n.n, v.x AS x1, v.y AS y1, w.x AS x2, w.y AS y2 FROM vertices v JOIN (SELECT pid, count(*) AS n FROM vertices GROUP BY pid) n USING (pid)
        JOIN vertices w ON w.pid = v.pid AND w.i = (v.i + 1) % n.n""",
    "crossing": """SELECT DISTINCT p.pid FROM edges p JOIN edges q ON p.pid = q.pid AND q.i > p.i + 1 AND NOT (p.i = 0 AND q.i = p.n - 1)
        WHERE least(p.x1, p.x2) <= greatest(q.x1, q.x2) AND greatest(p.x1, p.x2) >= least(q.x1, q.x2) AND least(p.y1, p.y2) <= greatest(q.y1, q.y2) AND greatest(p.y1, p.y2) >= least(q.y1, q.y2)
        AND ((p.x2-p.x1)*(q.y1-p.y1)-(p.y2-p.y1)*(q.x1-p.x1)) * ((p.x2-p.x1)*(q.y2-p.y1)-(p.y2-p.y1)*(q.x2-p.x1)) <= 0
        AND ((q.x2-q.x1)*(p.y1-q.y1)-(q.y2-q.y1)*(p.x1-q.x1)) * ((q.x2-q.x1)*(p.y2-q.y1)-(q.y2-q.y1)*(p.x2-q.x1)) <= 0""",
    "polygon_valid": """SELECT pid, slide_id, count(*) AS n_vertices, count(*) >= 3 AND abs(sum(x1 * y2 - x2 * y1)) > 0 AND pid NOT IN (SELECT pid FROM crossing) AS ok FROM edges GROUP BY pid, slide_id""",
    "map_a": "SELECT CAST(vec_id AS INTEGER) AS tile_id, CAST(k - 1 AS INTEGER) AS pix, (CAST(embedding[k] AS DOUBLE) - list_min(embedding)) / (CAST(list_max(embedding) AS DOUBLE) - list_min(embedding) + 1e-8) AS v FROM embeddings, (SELECT range AS k FROM range(1, 65))",
    "map_b": "SELECT CAST((tile_id + n - 250 % n) % n AS INTEGER) AS tile_id, pix, v FROM map_a, (SELECT count(*) AS n FROM embeddings)",
    "pair": "SELECT a.tile_id, a.pix, a.v AS a, b.v AS b FROM map_a a JOIN map_b b USING (tile_id, pix)",
    "att_scores": """SELECT CAST(vec_id AS INTEGER) AS tile_id, h AS head, i, j, CAST(embedding[32 * h + i + 1] AS DOUBLE) * CAST(embedding[32 * h + 11 + j] AS DOUBLE) AS s
        FROM embeddings, (SELECT CAST(range AS INTEGER) AS h FROM range(2)), (SELECT CAST(range AS INTEGER) AS i FROM range(10)), (SELECT CAST(range AS INTEGER) AS j FROM range(10))""",
    "attn": "SELECT tile_id, head, i, j, exp(s - max(s) OVER w) / sum(exp(s - ms)) OVER w AS a FROM (SELECT *, max(s) OVER (PARTITION BY tile_id, head, i) AS ms FROM att_scores) WINDOW w AS (PARTITION BY tile_id, head, i)",
    "head_mean": "SELECT tile_id, i, j, avg(a) AS a FROM attn GROUP BY ALL",
    "patch_vec": "SELECT tile_id, CAST(j - 1 AS INTEGER) AS pix, a AS v FROM head_mean WHERE i = 0 AND j >= 1",
    "paths": f"SELECT path FROM {_sql_list(PATHS)} p(path)",
    "images": f"SELECT name FROM {_sql_list(IMAGES)} p(name)",
    "log": "SELECT vec_id AS epoch, round(abs(CAST(embedding[2] AS DOUBLE)), 1) AS acc, abs(CAST(embedding[3] AS DOUBLE)) AS loss, CAST(1 + vec_id % 3 AS BIGINT) AS n FROM embeddings",
}


def with_views(query: str) -> str:
    """The query behind the views that it needs, directly or through others."""
    import re

    names, need = list(SQL), set()
    uses = lambda text: {n for n in names if re.search(rf"\b{n}\b", text)}
    todo = uses(query)
    while todo:
        n = todo.pop()
        need.add(n)
        todo |= uses(SQL[n]) - need
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names if n in need) + " " if need else "") + query

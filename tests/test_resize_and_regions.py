"""Resizing by separable matrices, nested and large annotations, and plans without a forced broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attention, dice, grid, resize
from tessera.sources import regions


def plain_resize(picture, height, width):
    """Pixel by pixel: columns first, whole parts of 2^22, bytes after each pass."""

    def line(values, target):
        n, out = len(values), []
        step = n / target
        wide = max(step, 1.0)
        for o in range(target):
            w = [max(0.0, 1 - abs(i + 0.5 - (o + 0.5) * step) / wide) for i in range(n)]
            total = sum(w)
            out.append(min(255, max(0, (sum(int(v) * int(x / total * (1 << 22) + 0.5) for v, x in zip(values, w, strict=True)) + (1 << 21)) >> 22)))
        return out

    rows = [line(r, width) for r in picture.tolist()] if picture.shape[1] != width else picture.tolist()
    if len(rows) != height:
        rows = [list(r) for r in zip(*[line(c, height) for c in zip(*rows, strict=True)], strict=True)]
    return np.array(rows, dtype=np.uint8)


@pytest.mark.parametrize(("size", "target"), [((8, 8), (5, 5)), ((5, 9), (11, 4)), ((7, 7), (7, 3)), ((1, 1), (4, 4)), ((64, 48), (13, 13)), ((6, 6), (6, 6))])
def test_bytes_equal_the_plain_version(size, target):
    picture = np.random.default_rng(1).integers(0, 256, size, dtype=np.uint8)
    got = resize.resize_bytes(picture[None, :, :, None], *target)[0, :, :, 0]
    assert np.array_equal(got, plain_resize(picture, *target))


def test_large_tiles_and_those_that_fit(spark):
    random = np.random.default_rng(2)
    shapes = [(512, 512, 3), (224, 224, 3), (300, 200, 4), (64, 64, 1), (3, 40, 50)]
    pictures = [random.integers(0, 256, s, dtype=np.uint8) for s in shapes]
    rows = [(f"t{k}", p.tobytes(), *p.shape) for k, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "tile string, image binary, height int, width int, channels int")
    out = resize.resize_tiles(df, 224)
    got = {r["tile"]: r for r in out.collect()}
    assert out.columns == df.columns and all((r["height"], r["width"], r["channels"], len(r["image"])) == (224, 224, 3, 224 * 224 * 3) for r in got.values())
    assert got["t1"]["image"] == pictures[1].tobytes()
    of = lambda name: np.frombuffer(got[name]["image"], np.uint8).reshape(224, 224, 3)
    assert np.array_equal(of("t3")[:, :, 0], of("t3")[:, :, 2]) and np.array_equal(of("t3")[:, :, 1], plain_resize(pictures[3][:, :, 0], 224, 224))
    assert np.abs(of("t0").mean(axis=(0, 1)) - pictures[0].mean(axis=(0, 1))).max() < 1
    assert np.array_equal(of("t4")[:, :, 2], plain_resize(pictures[4][2], 224, 224))


def test_maps_take_the_sizes_of_others(spark):
    a = spark.createDataFrame([(1, 4, 4), (2, 2, 3), (3, 1, 1)], "tile_id int, height int, width int")
    b = spark.createDataFrame([(1, 2, 2, [0.0, 1.0, 0.5, 0.25]), (2, 2, 3, [0.1 * k for k in range(6)]), (4, 1, 1, [1.0]), (3, 1, 2, None)], "tile_id int, height int, width int, pixels array<double>")
    got = {r["tile_id"]: r for r in resize.resized_to(b, a).collect()}
    assert set(got) == {1, 2, 3} and got[3]["pixels"] is None
    assert got[2]["pixels"] == [int(0.1 * k * 255) / 255 for k in range(6)]
    want = plain_resize(np.array([[0, 255], [127, 63]], dtype=np.uint8), 4, 4) / 255
    assert np.allclose(np.array(got[1]["pixels"]).reshape(4, 4), want)


def test_regions_in_regions_and_large_rings(spark, tmp_path):
    vertex = lambda pts: "".join(f'<Vertex X="{x}" Y="{y}"/>' for x, y in pts)
    inner = f"<Region><Vertices>{vertex([(1, 1), (2, 1), (2, 2)])}<Vertex X='7'/></Vertices></Region>"
    outer = f"<Region><Vertices>{vertex([(0, 0), (9, 0), (9, 9)])}</Vertices><Regions>{inner}</Regions></Region>"
    turn = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    circle = list(zip((1000 * np.cos(turn)).round(3), (1000 * np.sin(turn)).round(3), strict=True))
    crossed = circle[:]
    crossed[100], crossed[30_000] = crossed[30_000], crossed[100]
    (tmp_path / "deep").mkdir()
    (tmp_path / "nested.xml").write_text(f"<Annotations><Annotation><Regions>{outer}</Regions></Annotation></Annotations>")
    for name, ring in (("circle", circle), ("crossed", crossed)):
        (tmp_path / "deep" / f"{name}.xml").write_text(f"<A><Region><Vertices>{vertex(ring)}</Vertices></Region></A>")
    got = {}
    for r in regions.read_regions(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append([(v["x"], v["y"]) for v in r["vertices"]])
    assert set(got) == {"nested.xml", "circle.xml"} and len(got["circle.xml"][0]) == 50_000
    assert got["nested.xml"] == [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]] or sorted(map(len, got["nested.xml"])) == [3, 6]


def test_extents_are_joined_as_their_size_asks(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0)], "slide_id string, x double, y double")
    assert "ResolvedHint" not in grid.grid_snap(df, 512)._jdf.queryExecution().analyzed().toString()


def test_attention_in_blocks_and_without_pairs_in_the_plan(spark, monkeypatch):
    random = np.random.default_rng(3)
    heads, tokens, dim = 3, 17, 4
    q, k = random.normal(size=(2, 9, heads, tokens, dim))
    df = spark.createDataFrame([(n, [float(v) for v in q[n].ravel()], [float(v) for v in k[n].ravel()]) for n in range(9)] + [(99, None, None), (98, [1.0], [1.0])], "tile_id int, q array<double>, k array<double>")
    s = q @ k.transpose(0, 1, 3, 2) / 2
    a = np.exp(s) / np.exp(s).sum(axis=-1, keepdims=True)
    mean = a.mean(axis=1)
    vectors = attention.patch_vectors(df, heads, tokens, dim)
    assert "Generate" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r["v"] for r in vectors.orderBy("tile_id").collect()], mean[:, 0, 1:])
    assert np.allclose([r["v"] for r in attention.head_means(df, heads, tokens, dim).orderBy("tile_id").collect()], mean.reshape(9, -1))
    for block in (1, 100, 2000):  # smaller than a query's row, a tile, some tiles
        monkeypatch.setattr(attention, "BLOCK_SCORES", block)
        out = np.zeros((9, tokens, tokens))
        for tiles, queries, values in attention.softmax_blocks(q, k, 0.5):
            out[tiles, queries] = values
        assert np.allclose(out, mean)
    maps = spark.createDataFrame([(n, [float(v) for v in (a[n] if n % 2 else a[n][:1]).ravel()]) for n in range(9)] + [(50, [0.5] * 10)], "tile_id int, a array<double>")
    want = [a[n].mean(axis=0)[0, 1:] if n % 2 else a[n, 0][0, 1:] for n in range(9)]
    assert np.allclose([r["v"] for r in attention.patch_vectors_of_maps(maps, tokens).orderBy("tile_id").collect()], want)
    square = attention.patch_vectors(df.where("tile_id < 9").select("tile_id", F.slice("q", 1, heads * 16 * dim).alias("q"), F.slice("k", 1, heads * 16 * dim).alias("k")), heads, 16, dim)
    q16, k16 = (x.reshape(9, -1)[:, : heads * 16 * dim].reshape(9, heads, 16, dim) for x in (q, k))
    s = q16 @ k16.transpose(0, 1, 3, 2) / 2
    a = np.exp(s) / np.exp(s).sum(axis=-1, keepdims=True)
    assert np.allclose([r["v"] for r in square.orderBy("tile_id").collect()], a.mean(axis=(1, 2)))


def test_best_bins_of_rows_of_counts():
    counts = np.zeros((4, 256))
    counts[0, [10, 200]] = 5
    counts[1, 7] = 3
    counts[3, [0, 255]] = 1
    assert dice.best_bin(counts).tolist() == [10, 0, 0, 0]

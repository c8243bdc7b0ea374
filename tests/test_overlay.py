"""Overlays against plain blending, and their PNGs read back by Spark's own image source."""

import random
import zlib

import numpy as np
import pytest

from tessera.operators import overlay
from tessera.sources import images

RECT = "slide_id string, row_idx long, cls string, x0 int, y0 int, x1 int, y1 int"
PICTURE = "slide_id string, width int, height int, pixels binary"
COLOUR = {"TP": (0, 255, 0), "FN": (255, 0, 0), "FP": (0, 0, 255)}


def picture(width, height, seed):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def plain(picture, rects):
    out = picture.copy()
    for _, _, cls, x0, y0, x1, y1 in sorted(rects, key=lambda r: r[1]):
        for y in range(max(y0, 0), min(y1, out.shape[0])):
            for x in range(max(x0, 0), min(x1, out.shape[1])):
                out[y, x] = [int(np.rint(float(v) * (1 - 0.4) + c * 0.4)) for v, c in zip(out[y, x], COLOUR[cls], strict=True)]
    return np.rot90(out, k=3)


@pytest.fixture(scope="module")
def drawn(spark):
    r = random.Random(4)
    shapes = {"S0": (37, 53), "S1": (20, 9), "S2": (1, 1), "S3": (64, 30)}
    pictures = {s: picture(*wh, k) for k, (s, wh) in enumerate(shapes.items())}
    rects = []
    for s, (w, h) in shapes.items():
        for k in range(60 if s != "S3" else 0):
            x, y = r.randint(-5, w), r.randint(-5, h)
            rects.append((s, k, r.choice(["TP", "FN", "FP"]), x, y, x + r.randint(0, 12), y + r.randint(0, 12)))
    rects += [("none", 1, "TP", 0, 0, 3, 3)]
    table = spark.createDataFrame([(s, p.shape[1], p.shape[0], p.tobytes()) for s, p in pictures.items()], PICTURE)
    return pictures, rects, table, spark.createDataFrame(rects, RECT).repartition(5)


@pytest.mark.parametrize("rows", [1, 7, 256])
def test_blended_in_order_over_bands_and_turned(drawn, rows):
    pictures, rects, table, rows_of = drawn
    found = {}
    for b in overlay.overlay(table, rows_of, rows).collect():
        found.setdefault(b["slide_id"], {})[b["top"]] = np.frombuffer(b["pixels"], np.uint8).reshape(-1, b["width"], 3)
    assert set(found) == set(pictures)
    for s, p in pictures.items():
        assert np.array_equal(np.concatenate([found[s][t] for t in sorted(found[s])]), plain(p, [r for r in rects if r[0] == s]))


def test_png_is_read_back_by_the_image_source(drawn, spark, tmp_path):
    pictures, rects, table, rows_of = drawn
    for r in overlay.as_png(overlay.overlay(table, rows_of, 7)).collect():
        (tmp_path / f"{r['slide_id']}_overlay.png").write_bytes(r["png"])
    (tmp_path / "broken.png").write_bytes(b"no image")
    names = spark.createDataFrame([(f"{s}_overlay",) for s in [*pictures, "missing"]], "slide_id string")
    read = {r["slide_id"]: r for r in images.thumbnails(names, str(tmp_path), ".png").collect()}
    assert set(read) == {f"{s}_overlay" for s in [*pictures, "missing"]} and not read["missing_overlay"]["found"]
    for s, p in pictures.items():
        r = read[f"{s}_overlay"]
        want = plain(p, [x for x in rects if x[0] == s])
        assert (r["height"], r["width"]) == want.shape[:2] and np.array_equal(np.frombuffer(r["pixels"], np.uint8).reshape(want.shape), want)
    gray = {r["name"]: r for r in images.read_gray_images(spark, str(tmp_path)).collect()}
    assert set(gray) == {f"{s}_overlay.png" for s in pictures}
    for s, p in pictures.items():
        r, g, b = np.moveaxis(plain(p, [x for x in rects if x[0] == s]).astype(int), 2, 0)
        assert np.allclose(gray[f"{s}_overlay.png"]["pixels"], ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).ravel() / 255, atol=0, rtol=1e-12)


def test_gray_and_jpeg_files(spark, tmp_path):
    jvm = spark._jvm
    for kind, name in ((10, "gray"), (5, "colour")):  # fixed values of the JVM's images: one byte of gray, three of colour
        image = jvm.java.awt.image.BufferedImage(6, 4, kind)
        for x in range(6):
            for y in range(4):
                image.getRaster().setSample(x, y, 0, 40 * x)
        for suffix in ("png", "jpg"):
            jvm.javax.imageio.ImageIO.write(image, suffix, jvm.java.io.File(str(tmp_path / f"{name}.{suffix}")))
    gray = {r["name"]: r for r in images.read_gray_images(spark, str(tmp_path)).collect()}
    assert len(gray) == 4 and np.allclose(np.array(gray["gray.png"]["pixels"]).reshape(4, 6), np.arange(6) * 40 / 255)
    assert all((r["height"], r["width"], len(r["pixels"])) == (4, 6, 24) for r in gray.values())
    read = {r["slide_id"]: r for r in images.thumbnails(spark.createDataFrame([("gray",), ("colour",), (None,)], "slide_id string"), str(tmp_path)).collect()}
    assert read["gray"]["found"] and len(read["gray"]["pixels"]) == 72 and not read[None]["found"]
    assert np.frombuffer(read["gray"]["pixels"], np.uint8).reshape(4, 6, 3).std(axis=2).max() == 0


def test_checksums_of_pieces():
    r = random.Random(0)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 70000)), r.randbytes(r.randint(0, 300))
        assert overlay.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_two_pictures_of_a_slide_are_an_error_and_none_give_none(drawn, spark):
    _, _, table, rects = drawn
    with pytest.raises(Exception, match="two pictures"):
        overlay.composite(overlay.bands(table.union(table)), overlay.coloured(rects)).collect()
    assert overlay.as_png(overlay.overlay(table.limit(0), rects)).collect() == []
    nulls = spark.createDataFrame([("S1", 1, "TP", None, 0, 3, 3), (None, 1, "TP", 0, 0, 3, 3)], RECT)
    assert sorted(bytes(b["pixels"]) for b in overlay.overlay(table, nulls, turn=False).collect()) == sorted(bytes(r["pixels"]) for r in table.collect())

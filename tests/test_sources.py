"""Sources, sinks and the stream, on files written by the tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dice
from tessera.sources import patches, regions
from tessera.streaming import ingest


def test_regions_from_xml(spark, tmp_path):
    ring = lambda pts: "<Region><Vertices>" + "".join(f'<Vertex X="{x}" Y="{y}"/>' for x, y in pts) + "</Vertices></Region>"
    body = ring([(0, 0), (4.5, 0), (4, 2)]) + ring([(0, 0), (1, 1)]) + ring([(0, 0), (5, 5), (5, 0), (0, 5)])
    (tmp_path / "s.xml").write_text(f"<Annotations><Annotation><Regions>{body}</Regions></Annotation></Annotations>")
    got = regions.read_regions(spark, str(tmp_path)).collect()
    assert [[(v["x"], v["y"]) for v in r["vertices"]] for r in got] == [[(0.0, 0.0), (4.5, 0.0), (4.0, 2.0)]]


def test_patches_and_labels(spark, tmp_path):
    df = spark.createDataFrame([("S", i, float(i), 0.0, [1.0, 2.0]) for i in range(4)], "slide_id string, row_idx long, x double, y double, features array<float>")
    df.write.parquet(str(tmp_path / "p"))
    back = patches.read_patches(spark, str(tmp_path / "p"))
    assert back.where("label IS NULL").count() == 4
    assert patches.first_rows(back, 2).count() == 2 and patches.first_rows(back, 0).count() == 4
    patches.write_labels(back.withColumn("label", F.lit(1)), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).agg(F.sum("label")).first()[0] == 4
    plan = patches.first_rows(patches.read_patches(spark, str(tmp_path / "p"), ["slide_id", "row_idx"]), 2)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(row_idx), LessThan(row_idx,2)]" in plan and "ReadSchema: struct<slide_id:string,row_idx:bigint>" in plan


def test_tiles_and_records(spark, tmp_path):
    spark.createDataFrame([("S", bytearray(b"x"))], "slide_id string, imgs binary").write.parquet(str(tmp_path / "t"))
    assert patches.read_tiles(spark, str(tmp_path / "t")).columns == ["slide_id", "image"]
    with pytest.raises(ValueError):
        patches.read_tiles(spark.range(1).write.parquet(str(tmp_path / "u")) or spark, str(tmp_path / "u"))
    raw = np.arange(12, dtype=np.uint8)
    data = [(f"{k:08d}", bytearray(raw.tobytes()), [2, 2, 3], "uint8", k % 2, "S") for k in range(5)]
    spark.createDataFrame(data, patches.RECORDS).write.parquet(str(tmp_path / "r"))
    rows = patches.read_records(spark, str(tmp_path / "r"), 3)
    got = patches.decode_records(rows).orderBy("key").collect()
    assert len(got) == 3 and got[0]["channel_means"] == raw.reshape(2, 2, 3).mean(axis=(0, 1)).tolist()
    patches.write_tiles(rows, str(tmp_path / "w"))


def test_gray_maps(spark, tmp_path):
    (tmp_path / "tile1.pgm").write_bytes(b"P5\n2 2\n255\n" + bytes([0, 51, 102, 255]))
    r = patches.read_gray(spark, str(tmp_path)).first()
    assert r["name"] == "tile1.pgm" and r["pixels"] == pytest.approx([0, 0.2, 0.4, 1])


def test_report(spark, tmp_path):
    dice.write_report(spark.createDataFrame([(2, 0.5), (1, 0.25)], "tile_id int, soft_dice double"), str(tmp_path / "csv"))
    part = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part"))
    assert part.read_text().splitlines() == ["tile_id,soft_dice", "1,0.25", "2,0.5"]


def test_stream(spark, tmp_path):
    data = [("S", i, "a", i % 2, 0.5, int(i < 3)) for i in range(6)]
    spark.createDataFrame(data, ingest.SCORES).repartition(2).write.parquet(str(tmp_path / "in"))
    ingest.write_batches(ingest.score_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    saved = spark.read.parquet(str(tmp_path / "out"))
    assert saved.agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0] == 6
    q = ingest.running_metrics(ingest.score_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").first()["tp"] == 1


def test_layouts_of_images(spark):
    a = np.arange(30, dtype=np.uint8).reshape(2, 5, 3)
    assert (patches.three_channels(a.tobytes(), (2, 5, 3)) == a).all()
    assert (patches.three_channels(a.transpose(2, 0, 1).tobytes(), (3, 2, 5)) == a).all()
    assert (patches.three_channels(a[..., 0].tobytes(), (2, 5)) == a[..., :1]).all() and patches.three_channels(bytes(32), (2, 4, 4)).shape == (2, 4, 3)
    with pytest.raises(ValueError):
        patches.three_channels(bytes(10), (2, 5, 1, 1))
    rows = spark.createDataFrame([("00000000", bytearray(bytes([10, 20, 30] * 4)), [2, 2, 3], "uint8", 1, "s")], patches.RECORDS)
    got = patches.decode_records(rows, mean=(1.0, 2.0, 3.0), std=(3.0, 6.0, 9.0)).first()["channel_means"]
    assert got == [3.0, 3.0, 3.0]


def test_replacing_the_labels_of_some_slides(spark, tmp_path):
    path = str(tmp_path / "labels")
    patches.write_labels(spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 0, 0)], "slide_id string, row_idx long, label int"), path)
    patches.replace_labels(spark.createDataFrame([("a", 0, 0)], "slide_id string, row_idx long, label int"), path)
    assert sorted((r["slide_id"], r["row_idx"], r["label"]) for r in spark.read.parquet(path).collect()) == [("a", 0, 0), ("b", 0, 0)]


def test_files_by_suffix(spark, tmp_path):
    for name in ("a.tumor.xml", "b.xml", "deep/c.tumor.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = patches.list_files(spark, str(tmp_path), ".tumor.xml").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == ["a.tumor.xml", "c.tumor.xml"] and {r["length"] for r in found} == {1}

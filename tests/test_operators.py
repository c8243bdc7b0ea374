"""Hand-computed cases of the patch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import align, attention, dice, geometry, grid, matching, metrics, model, rank, split, votes


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_ties_of_votes(spark):
    one = spark.range(1).select(
        votes.argmax_class(F.lit(0.5), F.lit(0.5)).alias("argmax"), votes.threshold_class(F.lit(0.5)).alias("threshold"), votes.soft_vote([F.lit(0.4), F.lit(0.6)]).alias("soft"),
        votes.hard_vote([F.lit(1), F.lit(1), F.lit(0)]).alias("two"), votes.hard_vote([F.lit(1)] * 4 + [F.lit(0)] * 5).alias("four"), votes.majority_label(F.lit(5), 9).alias("five"),
    ).first()
    assert tuple(one) == (0, 1, 1, 1, 0, 1)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("t", 0.1, 0), ("t", 0.4, 0), ("t", 0.4, 1), ("t", 0.8, 1), ("u", 0.3, 1), ("v", 0.5, 0), ("v", 0.5, 1)], "g string, score double, label int")
    assert rows(metrics.roc_auc(df, ["g"])) == [("t", 0.875), ("u", None), ("v", 0.5)]


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "pred int, label int")
    r = metrics.metrics(df).first()
    assert (r["sensitivity"], r["specificity"], r["accuracy"]) == (0.5, None, 0.5)
    none = metrics.metrics(df.where("pred > 5")).first()
    assert none["tp"] == 0 and none["accuracy"] is None and none["f1"] == 0.0


def test_best_epoch_is_the_earliest(spark):
    log = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, None)], "epoch int, acc double")
    assert metrics.best_epoch(log).first()["epoch"] == 1


def test_summary_of_one_value(spark):
    df = spark.createDataFrame([(0.25,)], "v double")
    assert tuple(metrics.score_summary(df, "v").first()) == (0.25, 0.25, 0.0, 1)
    assert metrics.score_summary(df.where("v > 1"), "v").first()["std"] is None


def test_slides_without_positives_do_not_rank(spark):
    df = spark.createDataFrame([("b", 1, 1, 1, 0), ("a", 1, 1, 1, 0), ("z", 0, 1, 0, 0)], "slide_id string, label int, m int, e int, h int")
    table = rank.slide_table(df, ["m"], ["e"], "h")
    assert [r["slide_id"] for r in rank.rank_slides(table, "max_disagreement").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        rank.rank_slides(table, "other")


def test_last_row_of_a_key_wins(spark):
    df = spark.createDataFrame([(s, "S", "k", i, lab) for s in range(3) for i, lab in ((0, 0), (1, 1))] + [(0, "S", "only", 5, 1)], "source_id int, slide_id string, key string, row_idx long, label int")
    assert rows(align.align_keys(df, 3).drop("parts")) == [("S", "k", 3, 1)]
    assert rows(align.align_report(df, 3)) == [("S", 1, 1, 0)]


def test_keys_round_half_to_even(spark):
    df = spark.createDataFrame([("S", 2.5, 3.5, 7), ("S", None, 1.0, 8)], "s string, x double, y double, i long")
    assert rows(df.select(align.patch_key(F.col("s"), F.col("x"), F.col("y"), F.col("i")))) == [("S|2,4",), ("S|idx:8",)]


def test_unequal_lengths(spark):
    f = spark.createDataFrame([("A", i, 1.0) for i in range(3)] + [("B", 0, 1.0)], "slide_id string, row_idx long, v double")
    lab = spark.createDataFrame([("A", i, 1) for i in range(2)] + [("B", 0, 0)], "slide_id string, row_idx long, label int")
    assert [r["slide_id"] for r in align.strict_scan(f, lab).collect()] == ["B"]
    assert align.truncating_scan(f, lab).count() == 3
    assert rows(align.count_mismatch(f, lab)) == [("A", 3, 2)]


POLYGONS = {
    "touches a corner": ([(10, 0), (10, -5), (15, -2)], True, True),
    "near miss": ([(10.5, 0), (20, 0), (20, 5), (10.5, 5)], True, False),
    "inside": ([(4, 4), (5, 4), (5, 5)], True, True),
    "around": ([(-5, -5), (50, -5), (50, 50), (-5, 50)], True, True),
    "concave, around a gap": ([(-5, -5), (15, -5), (15, 15), (12, 15), (12, -2), (-5, -2)], True, False),
    "two vertices": ([(0, 0), (5, 5)], False, False),
    "no area": ([(0, 0), (5, 5), (9, 9)], False, False),
    "bow tie": ([(0, 0), (5, 5), (5, 0), (0, 5)], False, False),
    "closed ring": ([(4, 4), (5, 4), (5, 5), (4, 4)], True, True),
}


def test_polygons(spark):
    data = [(k, [(float(a), float(b)) for a, b in v[0]]) for k, v in POLYGONS.items()]
    shapes = spark.createDataFrame(data, "slide_id string, vertices array<struct<x:double,y:double>>")
    valid = {r["slide_id"]: r["ok"] for r in shapes.select("slide_id", geometry.valid(F.col("vertices")).alias("ok")).collect()}
    assert valid == {k: v[1] for k, v in POLYGONS.items()}
    patches = shapes.select("slide_id", F.lit(0).cast("long").alias("row_idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert {r["slide_id"]: bool(r["label"]) for r in geometry.label_patches(patches, shapes, 10).collect()} == {k: v[2] for k, v in POLYGONS.items()}


def test_splits_have_exact_counts_whatever_the_partitions(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    a = split.three_way(df, F.col("id"), ["label"])
    b = split.three_way(df.repartition(13), F.col("id"), ["label"])
    assert rows(a) == rows(b)
    counts = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 534, (0, "validation"): 66, (0, "test"): 68, (1, "train"): 268, (1, "validation"): 33, (1, "test"): 34}
    few = split.two_way(spark.range(1), F.col("id"), 0.5, up=True)
    assert [r["split"] for r in few.collect()] == ["train"]


def test_thresholds():
    assert dice.parse_threshold(" OTSU ").kind == "otsu"
    assert dice.parse_threshold("p150").value == 100 and dice.parse_threshold("p-3").value == 0 and dice.parse_threshold("0.5") == dice.Threshold("number", 0.5)
    assert dice.report_name("x.y", "z", "p10", "0.5") == "dice_x.y_vs_z_fgp10_hard0p5.csv"


def test_otsu_of_a_constant_map_and_two_levels(spark):
    df = spark.createDataFrame([("c", 0.4)] * 4 + [("d", 0.1)] * 3 + [("d", 0.9)] * 3, "tile_id string, v double")
    found = dict(rows(dice.otsu(df)))
    assert found["c"] == 0.5 / 256 and found["d"] == 25.5 / 256


def test_memory_of_thresholds_does_not_grow_with_the_batch():
    import tracemalloc

    random = np.random.default_rng(1)
    bins = pd.Series([random.choice(dice.BINS, 8, replace=False).astype(np.int32) for _ in range(4000)])
    counts = pd.Series([random.integers(1, 9, 8).astype(float) for _ in range(4000)])
    peaks = []
    for n in (1000, 4000):
        tracemalloc.start()
        found = dice.bin_centres(bins[:n], counts[:n], dice.BINS)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] < 20_000_000
    one = np.zeros((1, dice.BINS))
    for k in range(0, 4000, 97):
        one[:] = 0
        one[0, bins[k]] = counts[k]
        assert found[k] == (dice.best_bin(one)[0] + 0.5) / dice.BINS
    assert len(found) == 4000 and len(dice.bin_centres(bins[:0], counts[:0], dice.BINS)) == 0


def test_empty_mask(spark):
    a = spark.createDataFrame([(1, k, 0.2) for k in range(4)], "tile_id int, pix int, v double")
    r = dice.compare(a, a, dice.parse_threshold("0.9"), dice.parse_threshold("p50")).first()
    assert (r["soft_dice"], r["hard_dice"], r["fg_fraction"]) == (0.0, 0.0, 0.0)
    same = dice.compare(a, a, dice.parse_threshold("0.1")).first()
    assert same["soft_dice"] == pytest.approx(1.0)


def test_rectangles_and_rotation(spark):
    cells = spark.createDataFrame([(0, 0, 0, 3, 2, "TP"), (1, 2, 1, 3, 2, "FN"), (2, 1, 0, 3, 2, "TN")], "row_idx int, col int, row int, n_cols int, n_rows int, cls string")
    drawn = rows(grid.draw_rectangles(cells, 100, 50).select("row_idx", "x0", "y0", "x1", "y1"))
    assert drawn == [(0, 0, 0, 35, 26), (1, 65, 24, 100, 50)]
    four = cells
    for _ in range(4):
        four = grid.rotate_clockwise(four)
    assert rows(four.select(*cells.columns)) == rows(cells)
    assert grid.colour(F.lit("TP")) is not None


def test_bilinear_against_numpy(spark):
    v = np.arange(9, dtype=float).reshape(3, 3) ** 2
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v.ravel())], "tile_id int, pix int, v double")
    got = np.array([r["v"] for r in attention.bilinear(df, 3, 6).orderBy("pix").collect()]).reshape(6, 6)
    at = np.clip((np.arange(6) + 0.5) / 2 - 0.5, 0, 2)
    low = np.floor(at).astype(int)
    high, part = np.minimum(low + 1, 2), at - low
    wide = v[:, low] * (1 - part) + v[:, high] * part
    assert np.allclose(got, wide[low] * (1 - part)[:, None] + wide[high] * part[:, None])


def test_names(spark):
    df = spark.createDataFrame([("x_tile12_tile3.png",), ("none.png",)], "name string")
    assert [r[0] for r in df.select(matching.tile_id(F.col("name"))).collect()] == [12, None]
    one = spark.range(1).select(matching.stem(F.lit("/a/b.c/x.y.h5")), matching.strip_suffix(F.lit("s_images_coords"))).first()
    assert tuple(one) == ("x.y", "s_images")


def test_network_scores_and_folding(spark):
    random = np.random.default_rng(0)
    w, b = random.normal(size=(4, 3)), random.normal(size=3)
    mean, var, gain, shift = random.normal(size=3), random.random(3) + 0.1, random.normal(size=3), random.normal(size=3)
    x = random.normal(size=(5, 4))
    fw, fb = model.fold_batch_norm(w, b, mean, var, gain, shift)
    assert np.allclose(x @ fw + fb, (x @ w + b - mean) / np.sqrt(var + 1e-5) * gain + shift)
    net = model.initial(4, (6, 5))
    table = spark.createDataFrame(model.weights_table({"m": net}), model.WEIGHTS_SCHEMA)
    back = model.networks_of(table)["m"]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, features array<float>")
    got = model.score(df, back).orderBy("k").collect()
    z = net.logits(np.array([r["features"] for r in got]))
    assert [r["pred"] for r in got] == (z[:, 1] > z[:, 0]).astype(int).tolist()
    assert np.allclose([r["prob"] for r in got], 1 / (1 + np.exp(z[:, 0] - z[:, 1])))


def test_training_separates_classes():
    random = np.random.default_rng(1)
    x = random.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    net, log = model.fit(x[:300], y[:300], (x[300:], y[300:]), hidden=(16,), epochs=30, rate=1e-2)
    assert max(a for _, _, a in log) > 0.93 and len(net.weights) == 2


def test_injected_encoder(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"abc"))], "id int, image binary")
    got = model.embed(df, lambda images: np.array([[len(i)] for i in images])).orderBy("id").collect()
    assert [r["features"] for r in got] == [[2.0], [3.0]]


def test_grids_take_extents_from_partial_aggregates(spark):
    df = spark.createDataFrame([("s", 10.0, 0.0), ("s", 1034.0, 512.0), ("s", 522.0, 1536.0), (None, 3.0, 3.0), (None, 259.0, 3.0)], "slide_id string, x double, y double")
    snapped = grid.grid_snap(df, 512)
    assert snapped.columns == ["slide_id", "x", "y", "col", "row", "n_cols", "n_rows"]
    got = sorted(snapped.select("x", "col", "row", "n_cols", "n_rows").collect())
    assert got == [(3.0, 0, 0, 1, 1), (10.0, 0, 0, 3, 4), (259.0, 0, 0, 1, 1), (522.0, 1, 3, 3, 4), (1034.0, 2, 1, 3, 4)]
    mode = grid.coordinate_mode(df, 512)
    assert {r["slide_id"]: r["mode"] for r in mode.collect()} == {"s": "topleft", None: "topleft"}
    for out in (snapped, mode):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_train_and_vote_trains_the_whole_job(spark, sf, monkeypatch):
    from tessera.plans import registry

    seen, train = {}, model.train_by_source

    def small(rows, **how):
        seen.update(how, widths={r[0] for r in rows.select(F.size("features")).distinct().collect()})
        return train(rows, hidden=(2,), epochs=1)

    monkeypatch.setattr(model, "train_by_source", small)
    registry.queries()["train_and_vote"](spark, sf)
    assert seen["hidden"] == model.HIDDEN and seen["epochs"] == 30 and seen["widths"] == {64}


def test_training_with_normalisation_dropout_and_three_classes():
    random = np.random.default_rng(2)
    x = random.normal(size=(900, 6)) * 5 + 3
    y = (x[:, 0] > 3).astype(int) + (x[:, 1] > 3)
    net, log = model.fit(x[:700], y[:700], (x[700:], y[700:]), hidden=(32, 16), epochs=40, rate=1e-2, classes=3, norm=True, dropout=(0.2, 0.1), drop_last=True)
    assert max(a for _, _, a in log) > 0.9 and [b.shape for b in net.biases] == [(32,), (16,), (3,)]
    assert (net.logits(x[700:]).argmax(axis=1) == y[700:]).mean() == max(a for _, _, a in log)


def test_gradients_with_normalisation():
    """One step from the same start lowers the loss of its batch, whatever parts the network has."""
    random = np.random.default_rng(3)
    x, y = random.normal(size=(64, 4)), random.integers(0, 2, 64)
    for norm in (False, True):
        _, log = model.fit(x, y, (x, y), hidden=(8, 8), epochs=25, batch=64, rate=5e-3, norm=norm)
        losses = [loss for _, loss, _ in log]
        assert all(b < a for a, b in zip(losses, losses[1:], strict=False))


def labelled(spark, n=600, seed=5):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 4)).round(3)
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    splits = np.where(np.arange(n) % 5 == 0, "validation", np.where(np.arange(n) % 11 == 0, "test", "train"))
    rows = [(s, k, str(splits[k]), [float(v) for v in x[k]], int(y[k])) for s in (0, 1) for k in range(n) if s == 0 or k % 2]
    return x, y, splits, spark.createDataFrame(rows, "source_id int, row_idx long, split string, features array<double>, label int")


HOW = {"hidden": (16, 8), "epochs": 6, "batch": 32, "rate": 1e-2, "norm": True, "dropout": (0.1,), "drop_last": True}


def test_a_source_of_one_shard_is_trained_as_in_one_task(spark):
    x, y, splits, df = labelled(spark)
    table = model.train_by_source(df, **HOW)
    got = {k: (n, {r["best_acc"] for r in table.collect() if r["model"] == k}) for k, n in model.networks_of(table).items()}
    for s in (0, 1):
        train, val = ((splits == name) & ((s == 0) | (np.arange(len(y)) % 2 == 1)) for name in ("train", "validation"))
        counts = np.bincount(y[train])
        net, log = model.fit(x[train], y[train], (x[val], y[val]), counts.sum() / (2 * counts), **HOW)
        assert got[str(s)][1] == {max(a for _, _, a in log)}
        assert all(np.allclose(p, q, rtol=1e-9, atol=1e-12) for p, q in zip([*net.weights, *net.biases], [*got[str(s)][0].weights, *got[str(s)][0].biases], strict=True))


def test_shards_are_averaged_and_learn_as_well(spark, monkeypatch):
    monkeypatch.setattr(model, "MANY", 2)
    x, y, splits, df = labelled(spark)
    for shard_rows in (600, 80):
        shards = model.packed_shards(df, shard_rows, 42).collect()
        assert sum(len(r["y"]) + len(r["val_y"]) for r in shards) == 8 * df.where("split <> 'test'").count() and all(len(r["y"]) + len(r["val_y"]) <= 8 * shard_rows for r in shards)
        assert len(shards) == (2 if shard_rows == 600 else 11)
        table = model.train_by_source(df.repartition(7), **HOW | {"epochs": 15, "batch": 8}, shard_rows=shard_rows).collect()
        assert {r["model"] for r in table} == {"0", "1"} and min(r["best_acc"] for r in table) > 0.93


def test_what_is_added_up_grows_with_tasks_and_not_with_shards(spark, monkeypatch):
    """Each task hands on one vector a source and epoch, however many shards it has; sums are those of all shards."""
    seen, summed = [], model.summed

    def counting(steps):
        seen.append((steps.count(), steps.selectExpr("sum(n)").first()[0]))
        return summed(steps)

    monkeypatch.setattr(model, "summed", counting)
    _, _, _, df = labelled(spark)
    assert model.packed_shards(df, 10, 42).count() > 60
    model.train_by_source(df, hidden=(4,), epochs=1, batch=8, shard_rows=10).collect()
    assert len(seen) == 2 and all(count <= 2 * (spark.sparkContext.defaultParallelism + 1) for count, _ in seen)
    assert seen[0][1] == df.where("split = 'train'").count()


def test_floats_are_packed_as_they_are(spark):
    df = labelled(spark, 60)[3].withColumn("features", F.col("features").cast("array<float>"))
    row = model.packed_shards(df.where("source_id = 0"), 100, 42).first()
    own = [r["features"] for r in df.where("source_id = 0 AND split = 'train'").orderBy("row_idx").collect()]
    assert row["width"] == 4 and np.frombuffer(row["x"], np.float32).reshape(-1, 4).tolist() == own
    assert row["labels"] == np.bincount(np.frombuffer(row["y"], np.int64)).tolist()


def test_one_epoch_of_two_shards_is_their_mean(spark):
    x, y, splits, df = labelled(spark, 200)
    df, how = df.where("source_id = 0"), {"hidden": (3,), "batch": 16, "rate": 1e-2}
    net = model.networks_of(model.train_by_source(df, epochs=1, shard_rows=120, **how))["0"]
    shards = model.packed_shards(df, 120, 42).orderBy("shard").collect()
    counts = np.bincount(y[splits == "train"])
    trained = []
    for r in shards:
        t, labels = model.Trainer(4, (3,), 2, counts.sum() / (2 * counts), 16, 1e-2), np.frombuffer(r["y"], np.int64)
        t.epoch(np.frombuffer(r["x"]).reshape(-1, 4), labels, np.random.default_rng([42, 0, r["shard"]]))
        trained.append((len(labels), t.net))
    assert len(trained) == 2
    for k in range(2):
        assert np.allclose(net.weights[k], sum(n * t.weights[k] for n, t in trained) / sum(n for n, _ in trained))


def test_gradients_against_finite_differences():
    """A first step of Adam moves each parameter by the rate against its gradient's sign, so signs are held against differences of the loss."""
    random = np.random.default_rng(6)
    x, y = random.normal(size=(12, 3)), random.integers(0, 2, 12)
    trainer, loss_of = model.Trainer(3, (4,), norm=True, rate=1e-9), lambda t: t.learn(x, y, random)
    before = [p.copy() for p in trainer.params]
    loss_of(trainer)
    for p, (now, was) in enumerate(zip(trainer.params, before, strict=True)):
        for place in list(np.ndindex(was.shape))[:6]:
            slope = []
            for change in (1e-5, -1e-5):
                probe = model.Trainer(3, (4,), norm=True, rate=0.0)
                probe.params[p][place] += change
                slope.append(loss_of(probe))
            gradient = (slope[0] - slope[1]) / 2e-5
            if abs(gradient) > 1e-4:
                assert np.sign(was[place] - now[place]) == np.sign(gradient), (p, place)


def test_auc_over_many_ranges(spark):
    """Against all pairs; scores are skewed, so that ranges by value would hold most of them at once."""
    random = np.random.default_rng(4)
    rows_ = [(g, float(np.round(random.random() ** 9, 4)), int(random.random() < 0.3)) for g in "ab" for _ in range(1500)] + [("a", 0.5, None), (None, 0.1, 1), (None, 0.2, 0)]
    df = spark.createDataFrame(rows_, "g string, score double, label int")
    got = dict(rows(metrics.roc_auc(df, ["g"]).where("g IS NOT NULL")))
    for g in "ab":
        pos, neg = (np.array([s for h, s, y in rows_ if h == g and y == k]) for k in (1, 0))
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want, abs=1e-12)
    assert [r["auc"] for r in metrics.roc_auc(df, ["g"]).where("g IS NULL").collect()] == [0.0]
    assert metrics.roc_auc(df, []).count() == 1


def test_best_epoch_by_group(spark):
    log = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("b", 0, None), ("b", 1, None)], "m string, epoch int, acc double")
    assert rows(metrics.best_epoch(log, by=["m"]).select("m", "epoch")) == [("a", 1), ("b", 0)]
    assert metrics.best_epoch(log.where("epoch > 5")).count() == 0


def test_rings_of_many_edges(spark):
    """A wavy ring of 600 vertices, valid and not, and patches in and around it, against the plain test of each pair."""
    angle = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    far = 900 + 200 * np.sin(7 * angle)
    ring = [(float(a), float(b)) for a, b in zip(1000 + far * np.cos(angle), 1000 + far * np.sin(angle), strict=True)]
    crossed = ring[:300] + [ring[450]] + ring[300:]
    shapes = spark.createDataFrame([("s", ring), ("s", ring), ("t", crossed)], "slide_id string, vertices array<struct<x:double,y:double>>")
    flags = geometry.with_validity(shapes).select("slide_id", "valid", geometry.valid(F.col("vertices")).alias("plain")).collect()
    assert sorted(tuple(r) for r in flags) == [("s", True, True), ("s", True, True), ("t", False, False)]
    random = np.random.default_rng(6)
    places = [(s, k, float(random.integers(-200, 2200)), float(random.integers(-200, 2200))) for s in ("s", "t") for k in range(200)]
    patches = spark.createDataFrame(places, "slide_id string, row_idx long, x double, y double")
    edges = patches.join(shapes.where("slide_id = 's'").limit(1).select("slide_id", geometry.edges(F.col("vertices")).alias("ring")), "slide_id")
    touched = F.exists("ring", lambda e: geometry.edge_meets_square(e, F.col("x"), F.col("y"), F.lit(64.0))) | geometry.inside(F.col("ring"), F.col("x"), F.col("y"))
    want = {r["row_idx"]: int(r["hit"]) for r in edges.select("row_idx", touched.alias("hit")).collect()}
    got = geometry.label_patches(patches, shapes, 64).collect()
    assert {r["row_idx"]: r["label"] for r in got if r["slide_id"] == "s"} == want and 0 < sum(want.values()) < 200
    assert not any(r["label"] for r in got if r["slide_id"] == "t")


def test_counts_that_differ_are_an_error(spark):
    a = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "slide_id string, v int")
    align.require_equal_counts([a, a])
    with pytest.raises(ValueError, match="t \\[1, 0\\]"):
        align.require_equal_counts([a, a.where("slide_id = 's'")])


def test_resample_is_exact_and_the_same_however_partitioned(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id < 450 THEN 0 WHEN id < 495 THEN 1 END AS label")
    a = split.weighted_resample(df, F.col("id"))
    assert a.count() == 500 and rows(a) == rows(split.weighted_resample(df.repartition(7), F.col("id")))
    share = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert all(120 < n < 220 for n in share.values()) and set(share) == {0, 1, None}
    assert split.weighted_resample(df.limit(0), F.col("id")).collect() == []


def test_limits_of_tiles(spark):
    a = spark.createDataFrame([(t, k, 0.2 * k) for t in (5, 1, 9, 7) for k in range(4)], "tile_id int, pix int, v double")
    b = a.where("tile_id <> 1")
    some = dice.compare(a, b, dice.parse_threshold("p10"), limit=2).collect()
    assert sorted(r["tile_id"] for r in some) == [5, 7] and dice.compare(a, b, dice.parse_threshold("p10")).count() == 3
    assert {r["tile_id"] for r in attention.first_tiles(a, 3).collect()} == {1, 5, 7}
    assert attention.as_heads(a).columns == ["tile_id", "head", "pix", "v"]


def test_report_of_three_classes(spark):
    df = spark.createDataFrame([("g", p, y) for p, y in ((0, 0), (0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (None, 1), (1, None))] + [("h", 5, 7)], "m string, pred int, label int")
    got = {(r["m"], r["entry"]): (round(r["precision"], 6), round(r["recall"], 6), r["support"]) for r in metrics.class_report(df, ["m"]).collect()}
    assert got["g", "0"] == (1.0, 0.666667, 3) and got["g", "1"] == (0.5, 0.5, 2) and got["g", "2"] == (0.5, 1.0, 1)
    assert got["g", "macro"] == (0.666667, 0.722222, 6) and got["g", "weighted"] == (0.75, 0.666667, 6)
    assert got["h", "5"] == got["h", "7"][:2] + (0,) == (0.0, 0.0, 0) and got["h", "7"] == (0.0, 0.0, 1)

"""Multilayer perceptrons over feature arrays: scoring by Arrow batches, and training over shards of each source whose parameters are averaged once an epoch.

A network is linear layers with ReLU between them; batch normalisation is folded into the layer before it, and dropout is there in training alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.split import shuffled_rank

HIDDEN = (512, 512, 256)
#: Units that training leaves out of each of these layers.
DROPOUT = (0.3, 0.3, 0.2)
#: Rows of a shard at most, and partitions whose sums one task adds up.
SHARD_ROWS, MANY = 16_384, 64
#: Rows that are scored at a time when a network is validated.
BLOCK = 4096


@dataclass
class Network:
    """Weights (inputs by outputs) and biases of each layer, first to last."""

    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            x = x @ w + b
            if k < len(self.weights) - 1:
                x = np.maximum(x, 0)
        return x


def fold_batch_norm(w: np.ndarray, b: np.ndarray, mean: np.ndarray, var: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """The layer that does what a linear layer and the batch normalisation behind it do."""
    scale = gain / np.sqrt(var + eps)
    return w * scale, (b - mean) * scale + shift


def initial(width: int, hidden: Sequence[int] = HIDDEN, classes: int = 2, seed: int = 42) -> Network:
    random = np.random.default_rng(seed)
    sizes = [width, *hidden, classes]
    return Network([random.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]])


def weights_table(networks: dict[str, Network]) -> list[tuple]:
    """Rows (model, layer, inputs, outputs, w, b) of networks, for a table that is written and read back."""
    return [(name, k, *w.shape, w.ravel().tolist(), b.tolist()) for name, n in networks.items() for k, (w, b) in enumerate(zip(n.weights, n.biases, strict=True))]


WEIGHTS_SCHEMA = "model string, layer int, inputs int, outputs int, w array<double>, b array<double>"


def networks_of(table: DataFrame) -> dict[str, Network]:
    """Networks from such a table. It holds models, not data, so it comes to the driver."""
    out: dict[str, Network] = {}
    for r in table.orderBy("model", "layer").collect():
        n = out.setdefault(r["model"], Network())
        n.weights.append(np.array(r["w"]).reshape(r["inputs"], r["outputs"]))
        n.biases.append(np.array(r["b"]))
    return out


def score(df: DataFrame, network: Network, features: str = "features", name: str = "") -> DataFrame:
    """``df`` with pred<name> (class of the larger logit, equal ones 0) and prob<name> (of class 1)."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("pred int, prob double")
    def run(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"pred": np.zeros(0, np.int32), "prob": np.zeros(0)})
        z = shared.value.logits(np.stack(x.to_numpy()).astype(np.float64))
        gap = z[:, 1] - z[:, 0]
        return pd.DataFrame({"pred": (gap > 0).astype(np.int32), "prob": 0.5 * (1 + np.tanh(gap / 2))})

    rows = df.withColumn("__s", run(F.col(features)))
    return rows.withColumns({f"pred{name}": F.col("__s.pred"), f"prob{name}": F.col("__s.prob")}).drop("__s")


def folded(weights: list[np.ndarray], biases: list[np.ndarray], norms: list[dict[str, np.ndarray]]) -> Network:
    """A network with each layer's normalisation, by its running mean and variance, folded into it."""
    pairs = [fold_batch_norm(w, b, n["mean"], n["var"], n["gain"], n["shift"]) if n else (w.copy(), b.copy()) for w, b, n in zip(weights, biases, norms, strict=True)]
    return Network([w for w, _ in pairs], [b for _, b in pairs])


class Trainer:
    """A network in training by Adam on weighted cross-entropy: its parameters, their moments and the running statistics of its normalisation, which all go into one vector."""

    def __init__(self, width: int, hidden: Sequence[int] = (32,), classes: int = 2, weights: np.ndarray | None = None, batch: int = 128, rate: float = 1e-3, seed: int = 42, norm: bool = False, dropout: Sequence[float] = (), drop_last: bool = False):
        self.net, self.batch, self.rate, self.drop_last, self.step = initial(width, hidden, classes, seed), batch, rate, drop_last, 0
        self.last = len(self.net.weights) - 1
        self.norms = [{"gain": np.ones(n), "shift": np.zeros(n), "mean": np.zeros(n), "var": np.ones(n)} if norm and k < self.last else {} for k, n in enumerate([*hidden, classes])]
        self.params = [*self.net.weights, *self.net.biases, *[n[p] for p in ("gain", "shift") for n in self.norms if n]]
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.weights = np.ones(classes) if weights is None else weights
        self.drops = [*dropout, *[0.0] * (self.last - len(dropout))]

    def _all(self) -> list[np.ndarray]:
        return [*self.params, *self.m, *self.v, *[n[p] for p in ("mean", "var") for n in self.norms if n]]

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self._all()])

    def load(self, vector: np.ndarray, step: int) -> None:
        at, self.step = 0, step
        for a in self._all():
            a[...] = vector[at : at + a.size].reshape(a.shape)
            at += a.size

    def folded(self) -> Network:
        return folded(self.net.weights, self.net.biases, self.norms)

    def epoch(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> list[float]:
        """Goes once over the rows in batches of a random order; the loss of each batch."""
        order, losses = random.permutation(len(y)), []
        for at in range(0, len(y), self.batch):
            i = order[at : at + self.batch]
            if self.drop_last and len(i) < self.batch and at:
                break
            losses.append(self.learn(x[i], y[i], random))
        return losses

    def learn(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> float:
        """One step on a batch; its loss."""
        net, norms, last, n = self.net, self.norms, self.last, len(y)
        acts, seen = [x], []
        for k, (w, b) in enumerate(zip(net.weights, net.biases, strict=True)):
            z = acts[-1] @ w + b
            if k == last:
                acts.append(z)
                break
            unit, scale = None, None
            if norms[k]:
                mean, var = z.mean(axis=0), z.var(axis=0)
                scale = 1 / np.sqrt(var + 1e-5)
                unit = (z - mean) * scale
                z = unit * norms[k]["gain"] + norms[k]["shift"]
                norms[k]["mean"] += 0.1 * (mean - norms[k]["mean"])
                norms[k]["var"] += 0.1 * (var * n / max(1, n - 1) - norms[k]["var"])
            stays = (random.random(z.shape) >= self.drops[k]) / (1 - self.drops[k]) if self.drops[k] else 1.0
            seen.append((z > 0, stays, unit, scale))
            acts.append(np.maximum(z, 0) * stays)
        z = acts[-1] - acts[-1].max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        own = self.weights[y]
        loss = float(-(own * np.log(p[np.arange(n), y] + 1e-12)).sum() / own.sum())
        grad = p.copy()
        grad[np.arange(n), y] -= 1
        grad *= (own / own.sum())[:, None]
        gw, gb, gains, shifts = [], [], [], []
        for k in range(last, -1, -1):
            if k < last:
                positive, stays, unit, scale = seen[k]
                grad = grad * stays * positive
                if unit is not None:
                    gains.insert(0, (grad * unit).sum(axis=0))
                    shifts.insert(0, grad.sum(axis=0))
                    grad = grad * norms[k]["gain"]
                    grad = scale * (grad - grad.mean(axis=0) - unit * (grad * unit).mean(axis=0))
            gw.insert(0, acts[k].T @ grad)
            gb.insert(0, grad.sum(axis=0))
            grad = grad @ net.weights[k].T if k else grad
        self.step += 1
        for q, g, mm, vv in zip(self.params, [*gw, *gb, *gains, *shifts], self.m, self.v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            q -= self.rate * (mm / (1 - 0.9**self.step)) / (np.sqrt(vv / (1 - 0.999**self.step)) + 1e-8)
        return loss


def right_of(network: Network, x: np.ndarray, y: np.ndarray) -> int:
    """How many rows a network tells the class of, a block at a time."""
    return sum(int((network.logits(x[at : at + BLOCK]).argmax(axis=1) == y[at : at + BLOCK]).sum()) for at in range(0, len(y), BLOCK))


def fit(
    x: np.ndarray, y: np.ndarray, validate: tuple[np.ndarray, np.ndarray], weights: np.ndarray | None = None, hidden: Sequence[int] = (32,), epochs: int = 10, batch: int = 128, rate: float = 1e-3, seed: int = 42,
    classes: int = 2, norm: bool = False, dropout: Sequence[float] = (), drop_last: bool = False,
) -> tuple[Network, list[tuple[int, float, float]]]:
    """The network of the best epoch by validation accuracy (the earliest of equal ones), by Adam on weighted cross-entropy; and (epoch, loss, acc).

    ``norm``: batch normalisation behind each hidden layer, which the result has folded in. ``dropout``: each hidden layer's share of units that a batch leaves out.
    ``drop_last``: an epoch's last batch is left out if it is short, unless it is the only one.
    """
    trainer, best, best_acc, log = Trainer(x.shape[1], hidden, classes, weights, batch, rate, seed, norm, dropout, drop_last), None, -1.0, []
    for epoch in range(epochs):
        losses, now = trainer.epoch(x, y, np.random.default_rng([seed, epoch, 0])), trainer.folded()
        acc = right_of(now, *validate) / len(validate[1]) if len(validate[1]) else 0.0
        log.append((epoch, float(np.mean(losses)) if losses else 0.0, acc))
        if acc > best_acc:
            best, best_acc = now, acc
    return best or trainer.folded(), log


SHARDS = "source_id string, shard long, x binary, y binary, val_x binary, val_y binary, width int, labels array<long>"
STEPS = "source_id string, n long, step long, vector binary, loss double, batches long, correct long, checked long"


def matrix_type(rows: DataFrame) -> type:
    """How a shard holds features: floats as they are, anything else as doubles."""
    return np.float32 if rows.schema["features"].dataType.simpleString() == "array<float>" else np.float64


def packed_shards(rows: DataFrame, shard_rows: int, seed: int, lanes: int | None = None) -> DataFrame:
    """The rows of each source, in hash order dealt to shards of ``shard_rows`` at most, as matrices: one row a shard, and rows of a shard in order of row_idx.

    A source's shards are dealt to ``lanes`` partitions, each shard's rows together and a source's shards one after another; a task holds one shard at a time. ``width`` is 0
    and ``labels``, the count of each, is empty where a shard has no row to train from.
    """
    kind = matrix_type(rows)

    def pack(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf, out, held = pd.concat(parts), {}, {}
        for split, names in (("train", ("x", "y")), ("validation", ("val_x", "val_y"))):
            part = pdf[pdf["split"] == split]
            x, held[split] = np.stack(part["features"].to_numpy()).astype(kind) if len(part) else np.zeros((0, 0)), part["label"].to_numpy(np.int64)
            out[names[0]], out[names[1]] = [x.tobytes()], [held[split].tobytes()]
            out.setdefault("width", [x.shape[1]])
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "shard": [pdf["shard"].iloc[0]]} | out | {"labels": [np.bincount(held["train"])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, at = [], None
        for batch in batches:
            new = (batch["source_id"] != batch["source_id"].shift()) | (batch["shard"] != batch["shard"].shift())
            for _, part in batch.groupby(new.cumsum(), sort=False):
                name = (part["source_id"].iloc[0], part["shard"].iloc[0])
                if parts and name != at:
                    yield pack(parts)
                    parts = []
                parts.append(part)
                at = name
        if parts:
            yield pack(parts)

    ranked = shuffled_rank(rows.where("split IN ('train', 'validation')"), F.col("row_idx"), ["source_id"], seed)
    shard = F.col("rank") % F.ceil(F.col("n") / shard_rows)
    dealt = ranked.select(F.col("source_id").cast("string").alias("source_id"), shard.alias("shard"), "row_idx", "split", "features", "label")
    dealt = dealt.repartition("source_id", F.col("shard") % lanes) if lanes else dealt.repartition("source_id", "shard")
    return dealt.sortWithinPartitions("source_id", "shard", "row_idx").mapInPandas(run, SHARDS)


def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps of sources, each source's one after another, added up: one a source, vectors by n. It holds one sum at a time."""
    source, total, vector = None, None, None
    done = lambda: pd.DataFrame([(source, int(total[0]), int(total[1]), (vector / max(1, total[0])).tobytes(), *total[2:])], columns=["source_id", "n", "step", "vector", "loss", "batches", "correct", "checked"])
    for batch in batches:
        for r in batch.itertuples(index=False):
            one = np.frombuffer(r.vector, dtype=np.float64) * r.n
            if r.source_id != source:
                if source is not None:
                    yield done()
                source, total, vector = r.source_id, [0, 0, 0.0, 0, 0, 0], np.zeros_like(one)
            vector += one
            total = [total[0] + r.n, max(total[1], r.step), total[2] + r.loss, total[3] + r.batches, total[4] + r.correct, total[5] + r.checked]
    if source is not None:
        yield done()


def summed(steps: DataFrame) -> DataFrame:
    """The steps of each source added up, vectors by n. Beyond MANY partitions sums go through lanes first."""
    if steps.rdd.getNumPartitions() > MANY:
        lanes = steps.withColumn("lane", F.spark_partition_id() % MANY)
        steps = lanes.repartition("source_id", "lane").sortWithinPartitions("source_id").drop("lane").mapInPandas(added, STEPS)
    return steps.repartition("source_id").sortWithinPartitions("source_id").mapInPandas(added, STEPS)


def train_by_source(rows: DataFrame, hidden: Sequence[int] = (32,), epochs: int = 10, batch: int = 128, rate: float = 1e-3, seed: int = 42, shard_rows: int = SHARD_ROWS, **how) -> DataFrame:
    """One model for each source_id from all its rows (source_id, row_idx, split, features, label), all sources and their shards side by side.

    Rows: model, layer, inputs, outputs, w, b, best_acc. ``how``: what else ``Trainer`` takes. In an epoch every shard goes on from the same parameters over its own rows; what comes out is averaged by rows,
    moments and running statistics too, and is the next epoch's start. A task adds up its shards of a source itself, so what is shuffled in an epoch grows with the tasks, two a core, and not with the rows. So a source of one shard is trained as ``fit`` does it, and one of many by as many tasks. What a job tells of accuracy is that
    of the parameters it began with. Models and their moments go through the driver, once an epoch; rows never do. A source without rows to train from has no model.
    """
    spark = rows.sparkSession
    counted = rows.where("split IN ('train', 'validation')").groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.count("*").alias("n")).collect()
    most = max((r["n"] for r in counted), default=0)
    alone = most <= shard_rows  # nothing to average
    lanes = max(1, min(-(-most // shard_rows), -(-2 * spark.sparkContext.defaultParallelism // max(1, len(counted)))))
    shards, kind = packed_shards(rows, shard_rows, seed, lanes).persist(StorageLevel.DISK_ONLY), matrix_type(rows)
    widths, labels = Counter(), defaultdict(Counter)
    for r in shards.where("width > 0").select("source_id", "width", F.posexplode("labels").alias("label", "n")).groupBy("source_id", "label").agg(F.max("width").alias("width"), F.sum("n").alias("n")).collect():
        widths[r["source_id"]] = max(widths[r["source_id"]], r["width"])
        labels[r["source_id"]][r["label"]] += r["n"]
    classes, trainers = how.pop("classes", 2), {}
    for source in sorted(labels):
        own = np.maximum(1, np.bincount(list(labels[source]), list(labels[source].values()), minlength=classes))
        trainers[source] = Trainer(widths[source], hidden, classes, own.sum() / (classes * own), batch, rate, seed, **how)
    best = {s: (t.folded(), -1.0) for s, t in trainers.items()}

    def job(epoch: int) -> list:
        shared = spark.sparkContext.broadcast(trainers)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    if r.source_id not in shared.value:
                        continue
                    trainer = shared.value[r.source_id]
                    before, start, step, width = trainer.folded(), trainer.vector(), trainer.step, len(trainer.net.weights[0])
                    matrix = lambda raw, w=width: np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, w)
                    y, val_y = np.frombuffer(r.y, dtype=np.int64), np.frombuffer(r.val_y, dtype=np.int64)
                    correct = right_of(before, matrix(r.val_x), val_y) if epoch and len(val_y) else 0
                    losses = trainer.epoch(matrix(r.x), y, np.random.default_rng([seed, epoch, r.shard])) if epoch < epochs else []
                    out = (r.source_id, len(y), trainer.step, trainer.vector().tobytes(), float(sum(losses)), len(losses), correct, len(val_y))
                    trainer.load(start, step)  # the next shard of this task begins where this one did
                    yield pd.DataFrame([out], columns=["source_id", "n", "step", "vector", "loss", "batches", "correct", "checked"])

        found = (shards.mapInPandas(run, STEPS) if alone else summed(shards.mapInPandas(lambda batches: added(run(batches)), STEPS))).collect()
        shared.destroy()
        return found

    try:
        for epoch in range(epochs + 1):
            for r in job(epoch):
                trainer = trainers[r["source_id"]]
                acc = r["correct"] / r["checked"] if r["checked"] else 0.0
                if epoch and acc > best[r["source_id"]][1]:
                    best[r["source_id"]] = (trainer.folded(), acc)
                trainer.load(np.frombuffer(r["vector"], dtype=np.float64), r["step"])
    finally:
        shards.unpersist()
    table = [(*row, best[row[0]][1]) for row in weights_table({s: n for s, (n, _) in best.items()})]
    return spark.createDataFrame(table, WEIGHTS_SCHEMA + ", best_acc double")


def embed(df: DataFrame, encoder: Callable[[list], np.ndarray], image: str = "image") -> DataFrame:
    """``df`` with ``features``, what an injected encoder makes of each batch of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["features"] = [r.astype(np.float32) for r in encoder(batch[image].tolist())]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, fields + ", features array<float>")

"""Language identification in two steps: the language family, then the language among its close relatives.

A text is a bag of hashed byte n-grams of its letters in lower case. One-versus-one linear support vector machines vote on the family; those
between the languages of the family that won vote on the language. Each machine is trained in a task of its own from a
bounded sample of labelled rows, the rows of lowest hash of every language, and they are few enough to go to every task.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; where no row is labelled all are; with a single language every
other text is it; a null id is in neither the sample nor the held-out part; repeated rows each get their row; an empty table
gives an empty result; other columns are ignored. Label, source and id are no inputs of a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import give_back, lean, map_rows, small_batches, table

#: Families of languages by code; a language that isn't here is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}
#: Buckets of hashed n-grams, their lengths in bytes, and the most labelled rows of a language that the machines learn from.
BUCKETS, GRAMS, SAMPLE = 1 << 13, (2, 3, 4), 500
PENALTY, EPOCHS, STEEPNESS = 4.0, 12, 4.0
LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a space, bytes of other characters stay.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Texts that are scored at a time, and characters of a text hashed at a time.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 20


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the n-gram counts of a whole text, of length 1 (or 0 where there are none)."""
    raw = b" " + b" ".join(text.lower().encode().translate(TO_SPACE).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8)
    counts = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(b), BLOCK_BYTES):
        part = b[at : at + BLOCK_BYTES + max(GRAMS) - 1].astype(np.uint32)
        room = min(BLOCK_BYTES, len(b) - at)
        for n in GRAMS:
            m = min(room, len(part) - n + 1)
            if m <= 0:
                continue
            code = part[:m].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) | part[k : k + m]
            code = (code + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435769)
            counts += np.bincount(code >> shift, minlength=buckets)
    x = np.sqrt(counts, dtype=np.float32)
    size = np.linalg.norm(x)
    return x / size if size else x


class Rows:
    """Rows of ``x`` in another order."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.x, self.order, self.shape = x, order, x.shape

    def __getitem__(self, i: int) -> np.ndarray:
        return self.x[self.order[i]]


def train_machine(x: np.ndarray | Rows, y: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> np.ndarray:
    """A linear support vector machine (squared hinge) for y in -1, 1, by dual coordinate descent; each class weighs the same.

    The last weight is the bias. ``x`` may be of half precision and read-only; nothing of its size is held beside it.
    """
    w, alpha = np.zeros(x.shape[1] + 1, dtype=np.float32), np.zeros(len(y))
    of_x = w[:-1]
    ones = max(1, int((y > 0).sum()))
    cost = np.where(y > 0, len(y) / (2 * ones), len(y) / (2 * max(1, len(y) - ones))) * penalty
    diagonal = 1 / (2 * cost)
    row = lambda i: x[i].astype(np.float32, copy=False)
    norm = np.array([row(i) @ row(i) for i in range(len(y))]) + 1 + diagonal
    random = np.random.default_rng(42)
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            x_i = row(i)
            slope = y[i] * float(of_x @ x_i + w[-1]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norm[i])
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                of_x += step * x_i
                w[-1] += step
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    """languages, family of each, and the weights of every machine by its two sides; a positive margin is for the first."""

    families: dict[str, str]
    machines: dict[tuple[str, str, str], np.ndarray]
    buckets: int = BUCKETS

    def vote(self, x: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number and its score in each row: the least that any machine gives it against another, as a probability."""
        names = sorted(names)
        wins = np.zeros((len(x), len(names)))
        least = np.ones((len(x), len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[(level, a, b)]
            p = 1 / (1 + np.exp(-STEEPNESS * (x @ w[:-1] + w[-1])))
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            least[:, i] = np.minimum(least[:, i], p)
            least[:, j] = np.minimum(least[:, j], 1 - p)
        best = np.argmax(wins + least, axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families:
            return labels, scores
        groups = sorted(set(self.families.values()))
        lettered = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        for at in range(0, len(lettered), BLOCK_TEXTS):
            rows = np.array(lettered[at : at + BLOCK_TEXTS])
            x = np.stack([features(texts[k], self.buckets) for k in rows])
            family, p = self.vote(x, "family", groups)
            for g, group in enumerate(groups):
                mine = np.flatnonzero(family == g)
                if len(mine):
                    names = sorted(k for k, f in self.families.items() if f == group)
                    best, q = self.vote(x[mine], "language", names)
                    for r, b in zip(rows[mine], best, strict=True):
                        labels[r] = names[b]
                    scores[rows[mine]] = p[mine] * q
        return labels, scores


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """lang and text of at most ``most`` rows of each language outside the held-out part: those whose ids have the lowest hashes."""
    rows = small_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = rows.groupBy("lang").count()
    hashed = F.xxhash64("doc_id", F.lit(7))
    # a hash bound that twice the wanted rows pass on average, so that few texts are sorted
    bound = F.least(F.lit(1.0), 2.0 * most / F.col("count") + 50 / F.col("count"))
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod(hashed, F.lit(1 << 30)) < bound * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 30)), "doc_id", F.xxhash64("text")))
    return few.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def train(docs: DataFrame, families: Mapping[str, str] = FAMILIES, most: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """A model from the labelled rows of ``docs``; the machines are trained side by side, one to a task."""
    family_of = dict(families)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "x": [features(t, buckets).astype(np.float16).tobytes() for t in batch["text"]]})

    sample = labelled_sample(docs, most).mapInPandas(lean(vectors), "lang string, x binary").persist()
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    groups = {n: family_of.get(n, n) for n in names}
    contests = [("family", a, b) for a, b in combinations(sorted(set(groups.values())), 2)]
    contests += [("language", a, b) for a, b in combinations(names, 2) if groups[a] == groups[b]]
    sides = [(lang, level, a, b, 1 if (groups[lang] if level == "family" else lang) == a else -1) for level, a, b in contests for lang in names if (groups[lang] if level == "family" else lang) in (a, b)]
    if not contests:
        sample.unpersist()
        return Model(groups, {}, buckets)

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        packed = rows.column("x").chunk(0)
        order = np.lexsort(([zlib.crc32(v.as_buffer()) for v in packed], rows.column("lang").to_numpy()))  # the same model whatever the order of rows
        # the vectors as they lie in the Arrow buffer, at half precision and without a copy
        x = np.frombuffer(packed.buffers()[2], dtype=np.float16, count=len(packed) * buckets, offset=packed.offset * buckets * 2).reshape(-1, buckets)
        w = train_machine(Rows(x, order), rows.column("y").to_numpy()[order])
        give_back()
        return rows.select(["level", "a", "b"]).slice(0, 1).append_column("w", pa.array([w.tobytes()], pa.binary()))

    spark = docs.sparkSession
    plan = spark.createDataFrame(sides, "lang string, level string, a string, b string, y int")
    trained = sample.join(F.broadcast(plan), "lang").groupBy("level", "a", "b").applyInArrow(one, "level string, a string, b string, w binary").collect()
    sample.unpersist()
    return Model(groups, {(r["level"], r["a"], r["b"]): np.frombuffer(r["w"], dtype=np.float32) for r in trained}, buckets)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. The model, some 33 KB a machine, goes with the task's code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["lang_pred"], batch["score"] = model.predict(batch.pop("text").tolist())
            yield batch

    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_rows(given, run, "held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least this score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                labels, scores = model.predict(texts.tolist())
                yield pd.Series(np.where(np.array(labels, dtype=object) == "und", -1.0, scores))
        finally:
            give_back()

    return small_batches(docs).where(score(F.col("text").cast("string")) >= least_score)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))

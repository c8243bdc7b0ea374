"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

A document is scanned once, word by word, while the zlib CRC states of the last n starts are held: each is extended by a space and the word, a new one
begins with the word, and every state that stands then is one n-gram's hash. The buckets that come out are written, so that no text is read or hashed
again. Their totals in corpus and target give each bucket's gain; a document's gains, summed, and Gumbel noise from a hash of its id give the score
by which documents are drawn without replacement.

Totals are summed in each task before they move, at most a row for each bucket. What is sorted is a few numbers for each document, dealt by ranges of the
score and written; ranks come from the ranges' sizes.

Edge cases: a null text has no words, so no features, weight 0 and no rank; a null id hashes like an empty one; repeated rows count and are drawn row by
row, and of equal scores and ids any row may come first; an empty table gives an empty result, and an empty target is one without features; other columns
are ignored, whatever their names; a text may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty, written

#: Bytes of words: digits, small letters, and all of a character beyond ASCII. Capitals become small letters, other bytes spaces.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Half the low bits of ``monotonically_increasing_id``: the row's number in its partition.
ROW_BITS = 33


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def ngram_hashes(words: Iterable[bytes], n: int) -> Iterator[int]:
    """The CRC of every run of 1 to n words, joined by one space."""
    ring: list[int] = []
    for word in words:
        tail = b" " + word
        ring = [crc32(word), *[crc32(tail, state) for state in ring[: n - 1]]]
        yield from ring


def hashed(docs: DataFrame, n: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id as doc_id, n_words, and the bucket of each of its features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = list(map(words_of, batch.pop("text")))
            batch["n_words"] = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            batch["buckets"] = [(np.fromiter(ngram_hashes(w, n), dtype=np.int64) % buckets).astype(np.int32) for w in words]
            yield batch

    return map_rows(small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), run, "n_words long, buckets array<int>")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln) of the ratio of target to corpus share, smoothed by one, of each bucket; a row for each bucket, at most, comes to the driver."""
    both = corpus.select(F.explode("buckets").alias("b"), F.lit(0).alias("side")).union(target.select(F.explode("buckets"), F.lit(1)))
    found = both.groupBy("b").agg(F.sum(1 - F.col("side")).alias("s"), F.sum("side").alias("t")).collect()
    s, t = [0] * buckets, [0] * buckets
    for r in found:
        s[r["b"]], t[r["b"]] = r["s"], r["t"]
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)]


def numbers(values: Iterable[int]):
    """A constant array of longs: one literal after constant folding, not an expression for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def gumbel_score(weight, doc_id, seed: int):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024,
               id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, and its rank among the drawn; null if it isn't drawn.

    Of the N documents of at least ``min_words`` words, floor(percent N / 100) are drawn: the highest scores, ties to the smaller id.
    """
    if n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("n and buckets must be 1 or more, percent between 0 and 100")
    corpus = written(hashed(docs, n, buckets, id_col, text_col), "buckets")
    aim = hashed(target.withColumn("doc_id", F.lit(None).cast("string")), n, buckets, "doc_id", target_text)
    gains = numbers(bucket_gains(corpus, aim, buckets))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(gains, b))
    scored = corpus.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = written(scored.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), "scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    dealt = scored.where(F.col("n_words") >= min_words).select(*columns, F.monotonically_increasing_id().alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    dealt = written(dealt.select(*columns, F.spark_partition_id().alias("part"), row.alias("row")), "ranks")
    before, total = [0] * parts, 0
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row for each partition
    for part in range(parts):
        before[part] = total
        total += sizes.get(part, 0)
    rank = F.col("row") + 1 + F.get(numbers(before), F.col("part"))
    drawn = dealt.select(*columns, F.when(rank <= percent * total // 100, rank).alias("rank"))
    return drawn.union(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is that of a drawn one; ids should be unique, and a row without an id is left out."""
    drawn = importance(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col))
    return docs.join(drawn, id_col, "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    """The same in SQL: the CRC of each distinct word is reduced over its bytes with a table of 256 entries."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH words AS (SELECT doc_id, {cut} AS ws FROM documents),
    aim AS (SELECT unnest({cut}) AS w FROM benchmark),
    steps AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
    lookup AS (SELECT list(c ORDER BY i) AS crcs FROM steps),
    flat AS (SELECT doc_id, unnest(ws) AS w FROM words),
    counted AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM flat UNION ALL SELECT w, 0, 1 FROM aim) GROUP BY w),
    spelt AS (SELECT w, s, t, hex(encode(w)) AS h FROM counted),
    coded AS (SELECT w, s, t, list_transform(range(1, length(h), 2), lambda k: 16 * (instr('0123456789ABCDEF', substr(h, k, 1)) - 1) + instr('0123456789ABCDEF', substr(h, k + 1, 1)) - 1) AS bytes FROM spelt),
    dealt AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM coded, lookup),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((sum(t) + 1.0::DOUBLE) * (any_value(all_s) + 10000) / ((sum(s) + 1.0::DOUBLE) * (any_value(all_t) + 10000)))) AS BIGINT) AS gain
        FROM dealt, totals GROUP BY bucket),
    weights AS (SELECT doc_id, sum(gain) AS weight FROM flat JOIN dealt USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM words LEFT JOIN weights USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
    """

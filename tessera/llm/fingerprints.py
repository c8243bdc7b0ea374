"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A text is lower-cased and reduced to words of letters and digits; each run of ``words`` words is a shingle (a text of fewer words is
one shingle), hashed by XXH64. The sketch keeps every hash below a fixed fraction of the hash range. Such sketches merge by union,
and the share of one sketch's hashes that is found in another estimates containment even where one document is many times longer. So that
no text with a word has an empty sketch, its smallest hash is kept as well; below the threshold sketches stay exact under merging.

Edge cases: a null text counts as empty; a text without words has the empty sketch (""), two empty sketches have likeness 1, an
empty and a non-empty one 0; repeated rows each get their row; rows with the same id follow each other in an order that their texts alone fix;
null ids come last; an empty table gives an empty result; the only row of a table is its own successor; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table, text_or_empty

#: Words of a shingle, and the fraction of the hash range that a sketch keeps.
WORDS, FRACTION = 5, 0.25
#: Rows that a range of ids holds about, in the search for the next document, and the most ranges of ids, whose bounds come to the driver.
RANGE_ROWS, MOST_RANGES = 500, 65_536
LEAST_ID, MOST_TIE = -(2**63), 2**63 - 1


def plain_words(text: Column) -> Column:
    """The text's words in lower case with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sketch(plain: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The sketch of what ``plain_words`` gave, as a sorted array of hashes. One chain of expressions: each text is scanned once."""
    if words < 2 or not 0 < fraction <= 1:
        raise ValueError("words must be 2 or more, fraction above 0 and at most 1")
    run = f"[^ ]++(?: [^ ]++){{{words - 1}}}"
    short = f"^[^ ]++(?: [^ ]++){{0,{words - 2}}}+$"
    shingles = F.regexp_extract_all(plain, F.lit(f"(?<![^ ])(?=({run}|{short}))[^ ]++"), F.lit(1))
    below = min(LEAST_ID + int(fraction * 2**64), 2**63 - 1)
    hashes = F.sort_array(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s))))
    return F.filter(hashes, lambda h, i: (h < F.lit(below)) | (i == 0))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two sketches' shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """The sketch of several texts together, from an array of their sketches."""
    return F.sort_array(F.array_distinct(F.flatten(sketches)))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def sketches(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and sketch of each row."""
    given = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return given.withColumn("plain", plain_words(F.col("text"))).select("doc_id", "text", sketch(F.col("plain"), words, fraction).alias("sketch"))


def longs(values: list[int]) -> Column:
    """A constant array, from one text: a literal for each element would take a call each."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def number_below(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted bounds are less than (key, tie), by bisection: a row looks at one bound for each bit of their number."""
    if not bounds:
        return F.lit(0)
    first, second = (longs(list(x)) for x in zip(*bounds, strict=True))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(low: Column, n: Column) -> Column:
        at = low + n
        here, its_tie = F.get(first, at - 1), F.get(second, at - 1)  # null behind the last bound
        return F.when((here < key) | (here == key) & (its_tie < tie), at).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def with_next(rows: DataFrame, ids: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row with the next smaller doc_id; after the smallest comes the largest.

    Rows are dealt into ranges of ids whose bounds are approximate quantiles, so no task sees all rows; an id that more rows have than a range should hold is dealt into
    several ranges by a hash of their texts. Each range also gets a copy of the first row of the range that follows it. ``ids`` (doc_id and text) is read for the
    bounds, its text only where an id is that frequent. What comes to the driver is one bound and one greatest id for each of at
    most MOST_RANGES ranges, and the frequent ids, of which there are fewer. Rows that are equal in id and text share a range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    n = ids.count()
    held = max(range_rows, math.ceil(n / MOST_RANGES))
    bounds, frequent = set(), {}
    if n > held:
        frequent = dict(map(tuple, ids.groupBy(key.alias("key")).count().where(F.col("count") > held).collect()))
        at = [k * held / n for k in range(1, math.ceil(n / held))]
        bounds = {(b, MOST_TIE) for b in ids.select(key.alias("key")).agg(F.percentile_approx("key", at, 50_000)).first()[0]}
        for k, count in frequent.items():
            parts = math.ceil(count / held)
            bounds |= {(k - 1, MOST_TIE)} if k > LEAST_ID else set()
            bounds |= {(k, LEAST_ID + p * 2**64 // parts) for p in range(1, parts)} | {(k, MOST_TIE)}
    tie = F.when(F.array_contains(longs(sorted(frequent)), key), F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if frequent else F.lit(0).cast("long")
    lot = number_below(sorted(bounds), F.col("__key"), F.col("__tie")).alias("lot")
    placed = lambda df: df.withColumns({"__key": key, "__tie": tie})
    tops = {r["lot"]: (r["key"], r["tie"]) for r in placed(ids).select(lot, "__key", "__tie").groupBy("lot").agg(F.max(F.struct("__key", "__tie")).alias("m")).select("lot", F.col("m.__key").alias("key"), F.col("m.__tie").alias("tie")).collect()}
    order = sorted(tops, reverse=True)
    # a range's guests have the greatest id of the range after it; the last range's have the greatest of all
    host = dict(zip(order[1:] + order[:1], order, strict=True))
    of_lot = lambda values: F.get(longs([values.get(k, 0) for k in range(max(tops, default=0) + 1)]), F.col("lot"))
    dealt = placed(rows).withColumn("lot", lot)
    first = (F.col("__key") == of_lot({k: t[0] for k, t in tops.items()})) & (F.col("__tie") == of_lot({k: t[1] for k, t in tops.items()}))
    own, copy = F.struct(F.col("lot").cast("long").alias("lot"), F.lit(0).alias("guest")), F.struct(of_lot(host).alias("lot"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("__copy", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))).drop("lot").select("*", "__copy.lot", "__copy.guest").drop("__copy")
    w = Window.partitionBy("lot").orderBy("guest", F.col("__key").desc(), F.col("__tie").desc(), F.col("doc_id").desc_nulls_last(), "text")
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return following.where("guest = 0").drop("lot", "guest", "__key", "__tie")


def edited_fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last third replaced from the next document."""
    rows = with_next(sketches(docs, words, fraction), docs.select("doc_id", text_or_empty().alias("text")), ["text", "sketch"], range_rows)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), plain_words(F.col("edited")).alias("plain"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("plain"), words, fraction))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by a low-discrepancy schedule.

Each source has a target in words. The targets, laid end to end, are an interval that a grid of 2^m points cuts; slot i of the schedule stands at the i-th van der
Corput point, and the source whose part of the interval that point falls in has the slot. So the points themselves give each source its number of slots,
and their order has the sources near their weights in each stretch of slots. The slots of a source are ranked. Its documents, in a shuffled order fixed by
hashes, lie end to end on an axis of words, which is cut into equal blocks, as many as make up the target in the source's slots; the slot of
rank r takes the r-th block of the axis, which starts anew behind its end. So a source's mix is its target, less a fraction of a word.

The sources are a table: their order, targets and parts come from running sums in two levels and a few aggregations, as ranks and positions do (of chunks
of slots, of buckets of documents). No task holds a whole source, however large its share of the rows, and only totals come to the driver.

Edge cases: a null text has size 0; a null source is a source, after all others; sources without words have target 0; a source so small that no point
falls in its part has one slot, whose number its name's hash gives; repeated rows are each laid on the axis; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import carrying, give_back, small_batches, table, written

#: Words of a block at most, slots ranked in one task at a time, and rows of a bucket about.
BLOCK_WORDS, CHUNK_SLOTS, BUCKET_ROWS = 256, 1 << 14, 2_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Weights of the sources by code point, repeating, and the share of all sizes that the mix has.
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2.0
#: The mixed documents lie in up to 2^16 stretches of slots.
STRETCH_BITS = 16


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, value: str, name: str, part: str, order: Sequence[Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before, in the order of ``part`` and then ``order``, within ``groups``.

    Sums of whole parts come first, so that a task sorts one part of a group, never the group. The join of both is a merge of rows that are sorted
    already; the planner can't tell how many rows an explode makes, and might broadcast them.
    """
    by = [*groups, part]
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*by).agg(F.sum(value).alias("__n")).select(*by, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum(value).over(inside)).join(bases.hint("merge"), by)
    return rows.withColumn(name, F.col("__base") + F.col("__upto") - F.col(value)).drop("__base", "__upto")


def shared_out(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source_size, place) with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size.

    What is above goes to the others by weight until none is above: a few aggregations find the words that a weight of one gets.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weights")
    facts = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total, unit = share * (facts[0] or 0), 0.0
    new = total / facts[1] if facts[1] else 0.0
    while new > unit:
        unit = new
        above = F.col("weight") * unit > F.col("cap")
        capped, free = rows.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (capped or 0.0)) / free if free else unit
    return rows.withColumn("target", F.least(F.col("weight") * unit, F.col("cap"))).drop("weight", "cap")


def source_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """(a row for each source, the schedule's bits m). Columns: source, k (its place), source_size, target, words (the target's whole words), first_point, slots."""
    names = (F.col("source").isNull(), F.col("source"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # parts of the order by code point
    sums = written(sums.repartitionByRange(*names).select("*", F.spark_partition_id().alias("part"), F.lit(1).cast("long").alias("one")), "sources")
    placed = running(sums, "one", "place", "part", names)
    rows = shared_out(placed, weights, share, most).withColumn("words", F.floor("target").cast("long"))
    rows = written(running(rows, "words", "from", "part", ["place"]), "targets")
    total = rows.agg(F.sum("words")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / block))))
    point = lambda words: F.ceil(words / F.lit(float(max(1, total))) * F.lit(float(2**bits))).cast("long")
    rows = rows.withColumn("first_point", point(F.col("from"))).withColumn("points", point(F.col("from") + F.col("words")) - F.col("first_point"))
    slots = F.when(F.col("words") > 0, F.greatest("points", F.lit(1))).otherwise(0).cast("long")
    return rows.select("source", F.col("place").alias("k"), "source_size", "target", "words", F.when(F.col("points") > 0, F.col("first_point")).alias("first_point"), slots.alias("slots")), bits


def reversed_bits(point: Column, bits: int) -> Column:
    """The number of the van der Corput point that stands at ``point`` / 2^bits: its bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(point), max(1, bits), "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, bits: int, chunk: int = CHUNK_SLOTS, sequence: Callable[[Column, int], Column] = reversed_bits) -> DataFrame:
    """slot, k and rank of every slot, with the source's source_size, words and slots.

    The points of a source's part of the interval are neighbours on the grid; ``sequence`` gives the number of the point at a place.
    """
    stretches = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long"))
    partitions = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sources.where("slots > 0").withColumn("at", F.explode(stretches)).repartition(partitions, "k", "at")
    rows = rows.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + chunk, F.col("slots")) - 1)))
    alone = F.pmod(F.xxhash64("source"), F.lit(2**bits))
    slot = F.when(F.col("first_point").isNull(), alone).otherwise(sequence(F.col("first_point") + F.col("at"), bits))
    rows = rows.select(slot.alias("slot"), "k", "source_size", "words", "slots", F.lit(1).cast("long").alias("one"))
    rows = rows.withColumn("chunk", F.floor(F.col("slot") / chunk))
    return running(rows, "one", "rank", "chunk", ["slot"], ["k"]).drop("one", "chunk")


def laid_out(sized: DataFrame, sources: DataFrame, bucket_rows: int = BUCKET_ROWS, seed: int = 42) -> DataFrame:
    """``sized`` with k and ``first``, the place of a document's first word on its source's axis in shuffled order."""
    rows = sized.join(sources.select(F.col("source").alias("__name"), "k", "source_size", "target", "slots"), F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    buckets = max(1, math.ceil(sized.count() / bucket_rows))
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    # the size decides between rows that have the same id, so only rows that are equal here can change places
    return running(rows, "size", "first", "bucket", ["order", "doc_id", "size"], ["k"]).drop("order", "bucket")


def takes(plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The words that each slot takes: k, cell (a stretch of ``block`` words of the axis), lo and hi (words on the axis), slot and rank.

    A slot's block that passes the axis's end goes on at its start, as a row of its own.
    """
    each = F.col("words") / F.col("slots")
    begin, end = F.floor(F.col("rank") * each), F.when(F.col("rank") + 1 == F.col("slots"), F.col("words")).otherwise(F.floor((F.col("rank") + 1) * each))
    plan = plan.select("k", "slot", "rank", begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.col("source_size").alias("axis")).where("end > begin")
    # each turn of the axis that the block meets: one, or more where a source is shorter than a block
    plan = plan.withColumn("turn", F.explode(F.sequence(F.floor(F.col("begin") / F.col("axis")), F.floor((F.col("end") - 1) / F.col("axis")))))
    lo = F.greatest("begin", F.col("turn") * F.col("axis")) - F.col("turn") * F.col("axis")
    hi = F.least("end", (F.col("turn") + 1) * F.col("axis")) - F.col("turn") * F.col("axis")
    plan = plan.select("k", "slot", "rank", "turn", lo.alias("lo"), hi.alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    return plan.withColumn("cell", F.explode(cells)).select("k", "slot", "rank", "turn", "cell", F.greatest("lo", F.col("cell") * block).alias("lo"), F.least("hi", (F.col("cell") + 1) * block).alias("hi"))


def mix_pieces(laid: DataFrame, plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: for each slot the stretches of documents that it takes, as row, slot, turn, from_word and to_word in the document."""
    last = F.col("first") + F.col("size")
    cells = F.sequence(F.floor(F.col("first") / block), F.floor((last - 1) / block))
    spread = laid.where("size > 0").select("row", "k", "first", last.alias("last"), F.explode(cells).alias("cell"))
    met = spread.join(takes(plan, block).hint("merge"), ["k", "cell"]).where("lo < last AND first < hi")
    return met.select("row", "k", "slot", "turn", (F.greatest("lo", "first") - F.col("first")).alias("from_word"), (F.least("hi", "last") - F.col("first")).alias("to_word"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK_WORDS, row: str | None = None, sequence: Callable[[Column, int], Column] = reversed_bits
) -> tuple[DataFrame, DataFrame, int]:
    """(documents with row, size, place and their source's figures; the stretches that the mix takes of them; the schedule's bits). Texts are read once and not shuffled.

    ``row`` names a column that tells rows apart; without one they are numbered.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), number.alias("row"))
    sized = written(sized, "sizes")
    sources, bits = source_table(sized, weights, share, most, block)
    sources = written(sources, "shares")
    laid = laid_out(sized, sources)
    return laid, mix_pieces(laid, schedule(sources, bits, sequence=sequence), block), bits


def words_between(text: str, i: int, j: int) -> str:
    """The part of a text from its word i up to its word j (exclusive), as it stands."""
    begin = end = n = 0
    for n, m in enumerate(WORD.finditer(text), 1):
        if n == i + 1:
            begin = m.start()
        if n <= j:
            end = m.end()
    return text if i == 0 and j >= n else text[begin:end]


@F.pandas_udf(T.StringType())
def cut_out(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    try:
        for texts, first, last in batches:
            yield pd.Series([words_between(t, i, j) for t, i, j in zip(texts, first, last, strict=True)], dtype=object)
    finally:
        give_back()


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK_WORDS, sequence: Callable[[Column, int], Column] = reversed_bits) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for every pass over a document, with the part of its text that the pass takes.

    What the mix doesn't take is left out; a document of which it takes more than the whole is there twice. n_chars, if there, follows. Rows lie in the order
    of their first slots: a stretch of slots is in one partition, where its rows are sorted, so that what reads them has the sources near their weights.
    Other columns may have any names.
    """
    return carrying(docs, lambda d: _passes(d, weights, share, most, block, sequence))


def _passes(docs: DataFrame, weights: Sequence[float], share: float, most: float, block: int, sequence: Callable[[Column, int], Column]) -> DataFrame:
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    columns, row = docs.columns, "doc_id"
    if ids[0] not in (None, 1) or ids[1]:  # ids that repeat or are null don't tell rows apart
        row = "__row"
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, pieces, bits = mixed(docs, weights, share, most, block, row, sequence)
    # what a pass takes of a document is one stretch of it
    passes = pieces.groupBy("row", "turn").agg(F.min("from_word").alias("__from"), F.max("to_word").alias("__to"), F.min("slot").alias("__slot"))
    rows = small_batches(docs).join(passes.withColumnRenamed("row", "__of").drop("turn"), F.col(row).eqNullSafe(F.col("__of")))
    stretch = F.shiftright("__slot", max(0, bits - STRETCH_BITS))
    rows = rows.repartition(stretch).sortWithinPartitions("__slot", row)
    rows = rows.withColumn("text", cut_out(F.col("text").cast("string"), "__from", "__to"))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK_WORDS, sequence: Callable[[Column, int], Column] = reversed_bits) -> DataFrame:
    """doc_id, size, source_size, target (the source's), taken (the words that the mix takes of each document), first_slot (that takes of it) and source_slots."""
    laid, pieces, _ = mixed(docs, weights, share, most, block, sequence=sequence)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    rows = laid.join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.col("slots").alias("source_slots"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))

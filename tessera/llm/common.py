"""What the corpus operators share: the shared folder, written tables and table reading."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in local mode, as in tests, a temporary one takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "tessera-shared")).rstrip("/")


#: Paths of the tables that this program has written, by scope; the outermost scope's stay until ``discard``.
_scopes: list[list[str]] = [[]]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in the shared folder and read back, and the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage and survives lost executors.

    The table stays for as long as lazy results may read it: until the ``scratch`` block that it was written in ends, or until ``discard``.
    """
    return written_at(df, label)[0]


def discard(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes written tables: those of ``paths``, or all that no open ``scratch`` block has. Call it when results that read them have been used."""
    gone = list(_scopes[0] if paths is None else paths)
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for scope in _scopes:
            if path in scope:
                scope.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Deletes at its end what was written inside. It gives a function that writes a table which stays: what later work is to read."""
    _scopes.append([])

    def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        kept, path = written_at(df, label)
        _scopes[-1].remove(path)
        _scopes[-2].append(path)
        return kept, path

    try:
        yield keep
    finally:
        discard(spark, _scopes[-1])
        _scopes.pop()


def give_back() -> None:
    """Returns memory that Python and Arrow have freed to the system, for the worker that stays between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def lean(run: Callable) -> Callable:
    """``run`` over batches, giving memory back when the task's batches are done."""

    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


#: Rows of an Arrow batch of texts: at 10,000, Spark's default, a few thousand characters a text make tens of MB in each worker.
BATCH_ROWS, DEFAULT_ROWS = 1_000, "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session, unless it has a setting of its own, hands Python BATCH_ROWS rows at a time from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == DEFAULT_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def map_rows(given: DataFrame, run: Callable, columns: str, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``given.mapInPandas(run)`` with the columns ``ids``, which ``run`` hands on, and then ``columns``.

    Whole-number ids go as text: beside a null, pandas holds such a column as floats, which round what is above 2^53.
    """
    kinds = {c: given.schema[c].dataType for c in ids}
    whole = {c: k for c, k in kinds.items() if isinstance(k, T.IntegralType)}
    sent = given.withColumns({c: F.col(c).cast("string") for c in whole})
    schema = [f"{c} {'string' if c in whole else k.simpleString()}" for c, k in kinds.items()]
    done = sent.mapInPandas(lean(run), ", ".join([*schema, columns]))
    return done.withColumns({c: F.col(c).cast(k) for c, k in whole.items()})


#: Bits of the map of ids by which rows are told apart before they are shuffled: 2 MB, however many ids there are.
MAP_BITS = 1 << 24


def may_have(rows: DataFrame, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rows`` with ``name``: false where ``ids``, a table of one column, doesn't have the row's id; true where it has it, and for a few others.

    The ids set bits of a map that goes to all tasks and doesn't grow with them, so no row is shuffled. With 1 id for 10 bits every tenth other row has true.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(MAP_BITS)) + 1
    bits = ids.select(place(F.col(ids.columns[0])).alias("at"))
    bits = bits.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map"))
    at = place(F.col(id_col))
    byte = F.conv(F.hex(F.substring("__map", (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.bitmap_bit_position(at) % 8)), F.lit(2)) == 1
    found = rows.withColumn("__at", F.bitmap_bucket_number(at)).join(F.broadcast(bits), F.col("__at") == F.col("__bucket"), "left")
    return found.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("__at", "__bucket", "__map")


def only(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id ``ids`` has. Of the others few are shuffled."""
    ids = ids.toDF(id_col)
    return may_have(rows, ids, id_col, "__may").where("__may").drop("__may").join(ids, id_col, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id ``ids`` doesn't have. Of these few are shuffled."""
    ids = ids.toDF(id_col)
    told = may_have(rows, ids, id_col, "__may")
    rest = told.where("__may").join(ids, id_col, "left_anti")
    return told.where("NOT __may").select(*rows.columns).unionAll(rest.select(*rows.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def carrying(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], own: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``; those that the stage doesn't know are in one struct meanwhile, so that none of its names can be theirs."""
    if not (others := [c for c in docs.columns if c not in own]):
        return stage(docs)
    whole = lambda c: F.col("`" + c.replace("`", "``") + "`")
    packed = docs.select(*[c for c in docs.columns if c in own], F.struct(*[whole(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("others"))
    place = {c: f"c{k}" for k, c in enumerate(others)}
    return stage(packed).select(*[F.col("others").getField(place[c]).alias(c) if c in place else F.col(c) for c in docs.columns])

"""A store of key-value tile records and a data source that reads it by ranges of keys.

The store is a folder of Parquet files, one folder for each range of 8-digit keys. ``records`` plans a partition for each range: a limit, and bounds on the key where the session pushes filters
to Python sources, leave out whole ranges before anything is opened. Files are read through Arrow's file systems, batch by batch.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.patches import RECORDS

#: Records of a range, rows of a batch, and the session's setting that hands filters to Python sources.
RANGE, BATCH_ROWS, PUSHDOWN = 1000, 256, "spark.sql.python.filterPushdown.enabled"
DIGITS = 8
ARROW = pa.schema([("key", pa.string()), ("image", pa.binary()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("label", pa.int32()), ("slide_id", pa.string())])


def write_store(records: DataFrame, path: str, per_range: int = RANGE) -> None:
    """Writes records as a store; a key that isn't of 8 digits is an error. Of equal keys all are kept."""
    key = F.when(F.col("key").rlike(f"^[0-9]{{{DIGITS}}}$"), F.col("key").cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a key: "), F.coalesce("key", F.lit("null")))))
    start = (key - key % per_range).cast("long")
    rows = records.select(*ARROW.names, F.lpad(start.cast("string"), DIGITS, "0").alias("from"))
    rows.repartition("from").sortWithinPartitions("from", "key").withColumn("from", F.concat(F.lit("k"), "from")).write.mode("overwrite").partitionBy("from").parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """The files of one range of keys."""

    files: tuple[str, ...]


class RecordReader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path = path
        #: keys at least and below which rows are read, as numbers
        self.least, self.below = 0, limit if limit > 0 else 10**DIGITS

    def partitions(self) -> list[Range]:
        """The ranges that can hold a wanted key; a range's end is the next one's start."""
        system, root = opened(self.path)
        folders = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and posixpath.basename(i.path).startswith("from=k"))
        starts = [int(posixpath.basename(f).removeprefix("from=k")) for f in folders]
        found = []
        for folder, start, end in zip(folders, starts, [*starts, 10**DIGITS][1:], strict=True):
            if start < self.below and end > self.least:
                files = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith(".parquet"))
                found.append(Range(tuple(files)))
        return found or [Range(())]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        least, below = f"{self.least:0{DIGITS}d}", f"{self.below:0{DIGITS}d}" if self.below < 10**DIGITS else None
        for file in partition.files:
            with system.open_input_file(file) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(BATCH_ROWS, columns=ARROW.names):
                    wanted = pc.greater_equal(batch["key"], least)
                    if below is not None:
                        wanted = pc.and_(wanted, pc.less(batch["key"], below))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.filter(wanted).columns, ARROW, strict=True)], schema=ARROW)


class PushedReader(RecordReader):
    """Takes bounds on the key too. Spark allows this method only where the session pushes filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("key",) or not isinstance(value, str) or not (value.isascii() and value.isdigit() and len(value) == DIGITS):
                yield f
                continue
            n = int(value)
            if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.below = min(self.below, n if isinstance(f, LessThan) else n + 1)
            if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.least = max(self.least, n + 1 if isinstance(f, GreaterThan) else n)
            if not isinstance(f, LessThan | LessThanOrEqual | EqualTo | GreaterThan | GreaterThanOrEqual):
                yield f


class RecordSource(DataSource):
    """``spark.read.format("records").option("limit", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> RecordReader:
        kind = PushedReader if self.options.get("pushed", "false") == "true" else RecordReader
        return kind(self.options["path"], int(self.options.get("limit", "0")))


def read_store(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The records of a store, those with a key below ``limit`` if it is above 0; of the ranges, only those that hold such keys are planned."""
    spark.dataSource.register(RecordSource)
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("records").option("limit", limit).option("pushed", pushed).load(path)

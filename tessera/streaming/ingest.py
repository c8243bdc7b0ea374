"""New files of scored patches as a stream, and running metrics of each model and slide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.metrics import confusion, metrics

SCORES = "slide_id string, row_idx bigint, encoder string, pred int, prob double, label int"


def score_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of scored patches, as they arrive."""
    return spark.readStream.schema(SCORES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_metrics(stream: DataFrame) -> DataFrame:
    """Metrics of each encoder and slide over all rows so far; the state is four counts a group."""
    return metrics(stream, ["encoder", "slide_id"])


def write_batches(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Confusion counts of each batch as Parquet by batch number: a batch that runs again overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        confusion(batch, ["encoder", "slide_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

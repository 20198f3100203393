"""Incremental runs as a stream: what has arrived since the last run is taken in micro-batches, then the stream ends.

The stream's checkpoint remembers which files have been read; the merges leave a batch that is given
again (after a lost driver) without effect. So each file counts once, and results equal those of one batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Batch = Callable[[DataFrame, int], None]


def run_available(spark: SparkSession, folder: str, schema: StructType | str, checkpoint: str, each: Batch, files_a_batch: int = 1_000) -> int:
    """Hands the Parquet files of ``folder`` that are new since the last run to ``each``, batch by batch; how many
    batches there were."""
    seen: list[int] = []

    def take(rows: DataFrame, number: int) -> None:
        each(rows, number)
        seen.append(number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start()
    query.awaitTermination()
    return len(seen)


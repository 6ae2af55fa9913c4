"""Build only what is missing: run a tile-local step on newly arrived files.

A file-source stream with the available-now trigger keeps the list of files
already done in its checkpoint, so a rerun touches new tiles only, and a lost
executor or driver resumes at the last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(
    spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], target: str,
    checkpoint: str, fmt: str = "parquet", max_files: int | None = None,
) -> None:
    """Apply ``work`` to every batch of new files under ``source`` and append
    the result under ``target``. Each batch overwrites its own folder, so a
    repeated batch leaves no duplicates. A file must hold whole tiles."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def save(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = (
        reader.load(source).writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    stream.awaitTermination()

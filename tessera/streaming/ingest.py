"""Structured Streaming ingest: the column logic of the batch jobs, driven by a file source to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the Parquet files of one table of a directory."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)


def run_to_end(stream: DataFrame, write, mode: str = "append") -> None:
    """Process all that is there now; write(batch, epoch) gets each micro-batch, the checkpoint keeps the cursor."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(spark: SparkSession, stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """Rows of a stream without repeats of a key within the watermark."""
    path = f"{shared_dir(spark)}/first-{uuid.uuid4().hex}"
    run_to_end(stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return spark.read.option("basePath", path).parquet(f"{path}/epoch=*").drop("epoch")

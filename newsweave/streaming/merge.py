"""Streaming ingestion: duplicates dropped under a watermark, and an exact merge per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsweave.operators.ingest import first_seen, with_ids, with_url
from newsweave.sources.sinks import append_master


def read_json_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def deduplicated(stream: DataFrame, ts: str, key: str = "id", late: str = "24 hours") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, late: str = "24 hours", width: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


def merge_batch(master_path: str):
    """A function for ``foreachBatch``: ids, first of each id in the batch, less those in the master, appended. A batch
    that is delivered twice adds nothing the second time."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = with_ids(with_url(batch))
        rows = first_seen(rows, "id", ["feed_key", "url"])
        try:
            rows = rows.join(spark.read.parquet(master_path).select("id"), "id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        append_master(rows, master_path)

    return run

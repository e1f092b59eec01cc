"""Incremental ingestion: new filings that arrive as files become chunks as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filigree.sources.filings import parse_filings, store_new


def stream_filings(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream over parquet files of ``content`` and filing fields."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest(stream: DataFrame, chunks_path: str, manifest_path: str, checkpoint: str) -> StreamingQuery:
    """Parse each micro-batch; a filing or chunk already stored is not stored again.

    The sink is idempotent by key, so a batch replayed after a failure changes
    nothing. Processes what is there and stops.
    """

    def batch(df: DataFrame, _: int) -> None:
        records, manifest = parse_filings(df.dropDuplicates(["accession_number"]))
        store_new(records, chunks_path, "chunk_id")
        store_new(manifest, manifest_path, "accession_number")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str = "ts", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """``window_start, n``: arrivals per tumbling window; rows later than ``late`` are dropped."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )

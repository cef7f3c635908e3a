"""The incremental ingest as a file stream: every run takes the files that have come since the last and stops."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermark.operators.assign import staged_filter
from tiermark.sources.snapshots import author_schema


def stage_new_files(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: T.StructType | None = None) -> None:
    """Filtered authors of new files appended to dst by updated_date, each file once (the checkpoint knows which)."""
    fields = [*(schema or author_schema()).fields, T.StructField("updated_date", T.DateType())]
    raw = spark.readStream.schema(T.StructType(fields)).parquet(src)
    staged = staged_filter(raw.select("id", F.col("summary_stats.h_index").alias("h_index"), "works_count", "affiliations", "topics", "updated_date"))
    query = staged.writeStream.format("parquet").partitionBy("updated_date").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

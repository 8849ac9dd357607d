"""Post cleaning on a stream.

Every cleaning stage (P1, F1-F5) is a stateless row expression, so the same
plan runs unchanged on a ``readStream`` source: no watermark and no state
store are needed, and each micro-batch is filtered independently.  Removed
rows can go to a second sink through the same ``stage`` flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echotrace.plans.clean import CleanParams, flag_posts


def read_post_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def clean_post_stream(stream: DataFrame, params: CleanParams) -> DataFrame:
    """Streaming DataFrame of the posts every filter keeps."""
    return flag_posts(stream, params).where(F.col("stage") == 0).drop("stage")


def start_clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                       schema: T.StructType, params: CleanParams, fmt: str = "parquet",
                       available_now: bool = True) -> StreamingQuery:
    """Start the cleaning stream into a file sink; the checkpoint makes it
    resume exactly where it stopped after a failure."""
    out = clean_post_stream(read_post_stream(spark, source_dir, schema, fmt), params)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

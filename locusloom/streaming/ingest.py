"""Ingestion of calls as a stream.

Attaching ids and leaving out listed calls needs no state: each micro-batch is
joined to static tables, and counts are kept by the checkpointed aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.genotype import SITE, attach_ids, exclude_calls, sample_filter
from ..sources.readers import CALLS


def call_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New call files of a folder, as they come."""
    return spark.readStream.schema(CALLS).option("sep", "\t").option("maxFilesPerTrigger", files_a_batch).csv(path)


def processed(stream: DataFrame, variants: DataFrame, samples: DataFrame, excluded_calls: DataFrame | None = None) -> DataFrame:
    """sample, variant_id, gt of known variants and samples."""
    rows = sample_filter(stream, samples)
    if excluded_calls is not None:
        rows = exclude_calls(rows, excluded_calls, [*SITE, "sample"])
    return attach_ids(rows, variants, check=False).select("sample", "variant_id", "gt")


def allele_counts(calls: DataFrame) -> DataFrame:
    """Running allele counts of the variants."""
    return calls.groupBy("variant_id").agg(F.sum("gt").alias("ac"), F.count("*").alias("carriers"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming form of the model-output checks.

Extraction, parsing and guard classification are row-local, so the batch operators
run unchanged on a stream: new output files are picked up incrementally and the
classified calls are appended to a Parquet sink. The checkpoint (on shared storage)
plus the file sink's commit log give exactly-once output across restarts and lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.outputs import classify_calls, parsed_calls

OUTPUT_SCHEMA = "output_id BIGINT, output STRING"


def classified_call_stream(spark: SparkSession, source: str, fmt: str = "json",
                           schema: str = OUTPUT_SCHEMA, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of classified tool calls for outputs landing in ``source``."""
    outputs = (spark.readStream.schema(schema).format(fmt)
               .option("maxFilesPerTrigger", max_files_per_trigger).load(source))
    return classify_calls(parsed_calls(outputs)).select(
        "output_id", "call_pos", "block_pos", "parse_path", "function_name", "sql", "status", "error",
        "effective_sql", "audit_sql")


def start_call_classification(spark: SparkSession, source: str, sink: str, checkpoint: str,
                              fmt: str = "json", available_now: bool = False) -> StreamingQuery:
    """Start the append-only classification stream into ``sink`` (Parquet)."""
    writer = (classified_call_stream(spark, source, fmt).writeStream.format("parquet")
              .option("path", sink).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()

"""Incremental tagging with Structured Streaming.

The pipeline has no cross-document state: each document's tokens and tags
depend only on that document, so new span documents arriving as files can be
aligned micro-batch by micro-batch with the batch operator (``foreachBatch``).
Each micro-batch overwrites its own ``batch=`` folder, so a batch that is run
again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagflow.operators import align
from tagflow.schema import SPAN_DOCS


def tag_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
               max_len: int | None = None, max_files_per_trigger: int | None = None,
               schema=SPAN_DOCS) -> StreamingQuery:
    """Watch ``source_dir`` for Parquet span documents; BIO tokens go to ``sink_dir``.

    ``checkpoint`` (required) is the stream's folder in the shared store; a restart with it goes on where it stopped.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        align.align(batch, max_len).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

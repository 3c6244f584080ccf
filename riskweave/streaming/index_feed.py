"""An extension: feed an index from a stream of message files.

Each micro-batch has whole files; the index takes their new and changed rows and drops
those they no longer have, so a batch that runs twice after a failure leaves the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import signature
from ..operators.segments import Index
from ..schema import COLUMNS

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("_file", *COLUMNS)]).add("_row", T.LongType())


def message_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Messages of Parquet files as they arrive, with signatures."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in COLUMNS}).withColumn("_signature", signature())


def feed_index(messages: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Update the index by the files of each batch, until the stream has no more input."""

    def batch(rows: DataFrame, _: int) -> None:
        Index(rows.sparkSession, index).update(rows, whole_files=True)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

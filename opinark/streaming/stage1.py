"""Reviews that arrive as files become cleaned sentences, once each.

The Column functions of the batch stage are used as they are. Repeated deliveries within the
watermark are dropped by key; later ones are left to the batch ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinark.functions import text as X
from opinark.operators import clean


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sentence_stream(reviews: DataFrame, time: str, keys: Sequence[str], late: str = "1 day", title: str = "title", text: str = "text") -> DataFrame:
    """Sentences of a stream of reviews: merged, deduplicated by keys, normalised, split and numbered."""
    merged = reviews.withColumn("review_text", X.merge_text(title, text)).where(clean.not_blank("review_text"))
    once = merged.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    normalized = once.withColumn("review_text", X.whitelist_lower("review_text"))
    return clean.split_marks(normalized, "review_text").select(*keys, time, "sentence_id", "sentence_text")


def counts_by_window(sentences: DataFrame, time: str, width: str = "1 hour", by: str | None = None) -> DataFrame:
    """Sentences per event-time window (and group)."""
    groups = [F.window(time, width)] + ([F.col(by)] if by else [])
    return sentences.groupBy(*groups).agg(F.count("*").alias("n_sentences"))


def write_stream(sentences: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table; all files there now are taken, then the query ends."""
    return sentences.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

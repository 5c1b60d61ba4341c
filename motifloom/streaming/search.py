"""Search over a stream of sequences: every step is narrow, so rows need no watermark and no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import clean
from ..operators.search import Motif, search


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_search(rows: DataFrame, motifs: Sequence[Motif], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches in each arriving text; append them to any sink."""
    return search(rows.select(key, clean(F.col(text)).alias("sequence")), motifs, key)


def hit_counts(hits: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Hits of each motif by window of event time; rows later than ``late`` are dropped with their window's state."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), "motif_ac").agg(F.count("*").alias("n"))

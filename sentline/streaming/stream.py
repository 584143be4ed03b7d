"""The engine on streams. All stages up to the sentence work inside the row, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..options import Options
from ..plans.pipeline import run


def text_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentence_stream(stream: DataFrame, key: str = "doc_id", options: Options = Options(), abbreviations: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """key, para_no, sent_no, sentence of a stream of texts."""
    return run(stream, key, options, abbreviations, phrases)


def sentence_counts(stream: DataFrame, key: str, time: str, late: str = "10 minutes", window: str = "1 hour", options: Options = Options()) -> DataFrame:
    """Sentences per window of event time; rows later than the watermark are left out."""
    kept = F.struct(key, time)
    s = run(stream.select(kept.alias("k"), "text"), "k", options).select(F.col(f"k.{time}").alias(time))
    return s.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n_sentences"))


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Micro-batches handed to a sink, with exactly the guarantees of foreachBatch."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

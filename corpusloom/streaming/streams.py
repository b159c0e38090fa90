"""The stateless steps as Structured Streaming: units and labels from arriving feedback, bad rows to a second sink, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank
from ..operators.labelling import Rules, with_labels
from ..operators.units import evidence_units


def feedback_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def labelled_units(feedback: DataFrame, id_col: str, text_col: str, topics: Rules, mechanisms: Rules, keep: list[str] | None = None) -> DataFrame:
    """Units with labels of each arriving text; the same code as in batch, without state."""
    return with_labels(evidence_units(feedback, id_col, text_col, keep), topics, mechanisms)


def write_units(feedback: DataFrame, id_col: str, text_col: str, topics: Rules, mechanisms: Rules, out: str, dead_letters: str, checkpoint: str) -> StreamingQuery:
    """Units to `out`, texts that are blank to `dead_letters`. Each batch writes to a folder of its own number and replaces it when it's run again."""

    def batch(rows: DataFrame, number: int) -> None:
        blank = is_blank(text_col)
        labelled_units(rows.filter(~blank), id_col, text_col, topics, mechanisms).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.filter(blank).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return feedback.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of keys in windows of event time; rows later than the watermark are dropped from state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))

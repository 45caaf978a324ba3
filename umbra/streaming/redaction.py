"""Redaction of streams: the same row expressions, and document entities by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import redact as R
from ..rules import LABOR, Policy


def redact_stream(segments: DataFrame, policy: Policy = LABOR, text: str = "text") -> DataFrame:
    """A streaming table of segments, redacted. No state: each row stands alone."""
    return R.digests(R.redact(segments, policy, text=text), text)


def counts_by_window(redacted: DataFrame, time: str, delay: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Occurrences by type and event-time window; rows later than the delay are left out."""
    rows = redacted.withWatermark(time, delay).select(time, F.explode("occurrences").alias("o"))
    return rows.groupBy(F.window(time, every), F.col("o.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def write_entities(redacted: DataFrame, doc: str, path: str, checkpoint: str) -> StreamingQuery:
    """Entities numbered by document, for each batch; a document's segments come in one batch."""

    def put(batch: DataFrame, number: int) -> None:
        found = R.entities(R.occurrences(batch, doc), doc).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return redacted.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

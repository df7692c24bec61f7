"""Consent events as a stream (optional re-aim; the batch operators are the
reference semantics).

File-source stream of consent events -> the same record projection as the
batch log (``quire.operators.audit.consent_records``) -> 1-day tumbling
windows per merchant and consent type with a 1-day watermark, appended to a
parquet sink. The checkpoint location must be a shared folder (the session's
``spark.checkpoint.dir`` by default) so a restarted query resumes exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.audit import consent_records
from quire.session import ensure_checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("merchant_id", T.StringType()), T.StructField("consent_type", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("expires_at", T.DateType()),
])

WATERMARK = "1 day"
WINDOW = "1 day"


def daily_consent_counts(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming DataFrame of consent events."""
    rec = consent_records(events).withColumn("ts", F.col("timestamp").cast("timestamp"))
    if rec.isStreaming:
        rec = rec.withWatermark("ts", WATERMARK)
    return (rec.groupBy(F.window("ts", WINDOW).alias("day"), "merchant_id", "consent_type")
            .agg(F.count(F.when(F.col("action") == "GRANTED", 1)).alias("granted"),
                 F.count(F.when(F.col("action") == "REVOKED", 1)).alias("revoked"))
            .select(F.col("day.start").alias("day_start"), "merchant_id", "consent_type", "granted", "revoked"))


def start_daily_consents(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source_dir)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-streams/consents-{uuid.uuid4().hex}"
    w = (daily_consent_counts(stream).writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", ckpt).option("path", sink_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

"""Streams of whole windows: sessions of voiced frames by their times alone, and ingest of utterance files without states.

voiced.py has the sessions with their true ends, ingest.py the ingest that can be run again, playback.py the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.dayview import transcript_rows
from .playback import clock  # noqa: F401


def voiced_sessions(frames: DataFrame, *, frame_ms: int = 20, silence: int = 10, late: str = "10 seconds") -> DataFrame:
    """Of a stream of frames (file, ts, is_speech): sessions of speech, closed by silence longer than the gap once the watermark passes."""
    gap = f"{(silence + 1) * frame_ms} milliseconds"
    speech = frames.where("is_speech").withWatermark("ts", late)
    found = speech.groupBy("file", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_speech"), F.max("ts").alias("last_ts"))
    return found.select("file", F.col("session_window.start").alias("start_ts"), "last_ts", "n_speech")


def ingest_utterances(spark: SparkSession, inbox: str, out: str, checkpoint: str, *, files_per_batch: int = 1000):
    """All waiting utterance documents to transcript rows below their days, each file once; returns the finished query."""
    raw = spark.readStream.schema(schemas.UTTERANCE + ", year string, month string, day string").option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(inbox)
    stream = transcript_rows(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("year", "month", "day").trigger(availableNow=True)
    done = stream.start()
    done.awaitTermination()
    return done


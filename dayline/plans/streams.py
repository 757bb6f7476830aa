"""Streams run to their end over files that are written from the tables, against one pass over the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..streaming import ingest, playback, voiced
from .fixtures import VOICED_SQL, voiced_rows
from .registry import Tables, query


def _run(stream: DataFrame, path: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def use_rocksdb(t: Tables) -> None:
    """The state store that streams with timers need."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("streamed_sessions", VOICED_SQL)
def streamed_sessions(t: Tables) -> DataFrame:
    """The frames of voiced_frames as a stream in disorder, in two runs that each take some of every file's frames and end marks; sessions are closed by the marks."""
    use_rocksdb(t)
    path = files.scratch(t.spark, "frames")
    rows = voiced_rows(t).select("file", "frame_no", "is_speech")
    ends = rows.groupBy("file").agg(F.max("frame_no").alias("frame_no")).withColumn("is_speech", F.lit(None).cast("boolean"))
    rows = rows.unionByName(ends).withColumn("ts", F.timestamp_millis(F.col("frame_no").cast("long") * 20))
    half = F.pmod(F.xxhash64("file", "frame_no", "is_speech"), F.lit(2))
    for n in (0, 1):  # the second run goes on with the first one's state
        rows.where(half == n).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        _run(voiced.voiced_sessions(stream, late="1 day", idle_ms=86_400_000), path)
    return t.spark.read.schema(voiced.SESSION).parquet(f"{path}/out")


@query(
    "ingested_files",
    """SELECT conv_id, 'done' AS state, count(*) FILTER (WHERE length(text) > 0)::BIGINT AS n_rows FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id
    UNION ALL SELECT DISTINCT conv_id, 'skipped', 0 FROM conversations WHERE conv_id % 5 = 0""",
)
def ingested_files(t: Tables) -> DataFrame:
    """Conversations as files of utterances, every fifth of them cut off in the middle: what became of each file, and the rows that it gave."""
    path = files.scratch(t.spark, "inbox")
    said = F.array(F.struct(F.col("text").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    rows = t.conversations.select("conv_id", "turn", said.alias("segments"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".json")).alias("filename"), F.lit("d").alias("descriptor"), F.lit("2024-01-01T00:00:00").alias("utteranceTime"))
    lists = F.array_sort(F.collect_list(F.struct("turn", "segments", "filename", "descriptor", "utteranceTime")))
    docs = rows.groupBy("conv_id").agg(F.to_json(lists).alias("value"))
    cut = F.when(F.col("conv_id") % 5 == 0, F.substr("value", F.lit(1), F.length("value") - 9)).otherwise(F.col("value"))
    files.write_each(docs.select("conv_id", cut.alias("value")), f"{path}/in", "conv_id")
    ingest.ingest(t.spark, f"{path}/in", f"{path}/out", f"{path}/state", bytes_per_batch=64 << 20)
    told = ingest.status(t.spark, f"{path}/in", f"{path}/out")
    given = ingest.ingested(t.spark, f"{path}/out").groupBy(F.regexp_extract("filename", "c([0-9]+)[.]", 1).cast("long").alias("conv_id")).agg(F.count_if(F.length("text") > 0).alias("n"))
    of = F.regexp_extract("file", "conv_id=([0-9]+)/", 1).cast("long")
    return told.select(of.alias("conv_id"), "state").join(given, "conv_id", "left").select("conv_id", "state", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(
    "playback_moments",
    """WITH v AS (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ts), p AS (SELECT ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ts),
    a AS (SELECT k.event_id, v.event_id AS last_view FROM events k ASOF LEFT JOIN v ON k.ts >= v.ts),
    b AS (SELECT k.event_id, k.ts, p.event_id AS e, p.ts AS t FROM events k ASOF LEFT JOIN p ON k.ts >= p.ts),
    c AS (SELECT k.event_id, p.event_id AS e, p.ts AS t FROM events k ASOF LEFT JOIN p ON k.ts <= p.ts)
    SELECT a.event_id, last_view, CASE WHEN c.t IS NULL OR epoch_us(b.ts) - epoch_us(b.t) <= epoch_us(c.t) - epoch_us(b.ts) THEN coalesce(b.e, c.e) ELSE c.e END AS near_purchase
    FROM a JOIN b USING (event_id) JOIN c USING (event_id)""",
)
def playback_moments(t: Tables) -> DataFrame:
    """Each event as a moment of the clock, run as a stream: the last view until then, and the purchase nearest to it."""
    path = files.scratch(t.spark, "moments")
    t.events.select("event_id", F.col("ts").cast("timestamp").alias("at")).write.parquet(f"{path}/in")
    ticks = t.spark.readStream.schema("event_id long, at timestamp").parquet(f"{path}/in")
    edges = t.events.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("b")).first()
    hours = playback.hours_between(t.spark, edges["a"] or "1970-01-01 00:00:00", edges["b"] or "1970-01-01 00:00:00")
    kind = lambda name: (t.events.where(F.col("event_type") == name).select("ts", "event_id"), "ts")
    found = playback.playing(ticks, hours, latest_of={"view": kind("view")}, nearest_to={"purchase": kind("purchase")})
    _run(found.select("event_id", F.col("view.event_id").alias("last_view"), F.col("purchase.event_id").alias("near_purchase")), path)
    return t.spark.read.schema("event_id long, last_view long, near_purchase long").parquet(f"{path}/out")

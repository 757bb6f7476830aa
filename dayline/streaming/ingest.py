"""Restartable ingest of utterance documents with the state of each file: waiting, in progress, done or skipped.

A stream takes each file of an inbox once, some in a batch. A batch's number is its transaction number: its rows go to
the folder of that number, and so does what became of its files, first "in progress", then "done" or
"skipped". A batch that is run again, since it died anywhere on the way, replaces its own folders, so rows
are there once whatever was written before. Readers see the rows of batches whose files are done.

Defined cases: a file that can't be read as documents is skipped whole, with the reason, and its readable rows
too; an empty file is done with no rows; worthless utterances are dropped as in transcript_rows; a file that
changes after it was taken is not taken again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.dayview import transcript_rows
from ..sources.files import exists, few_tasks, many_folders

#: State of a file after a batch's first and second step.
STATUS = "file string, state string, n_rows long, reason string, batch long, step int"
DOCUMENT = schemas.UTTERANCE + ", _corrupt_record string"


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def ingest(spark: SparkSession, inbox: str, out: str, checkpoint: str, *, files_per_batch: int = 1000, bytes_per_batch: int | None = None, between: Callable[[int], None] = lambda batch: None):
    """Takes all files of the inbox that wait (JSON, one document or an array each, below any folders), and returns the finished query.

    A batch takes files_per_batch files or, where bytes_per_batch is given, files of that many bytes: each batch costs
    seconds, so an inbox of very many small files needs the latter. out/rows has the transcript rows, out/status the states; `between` is called with the batch's number between the two, for tests.
    """
    most = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    with many_folders(spark):
        raw = spark.readStream.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option(*most).json(inbox)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        rows = few_tasks(rows).persist()  # read twice; if lost it is read again
        bad = F.col("_corrupt_record").isNotNull() | (F.col("utteranceTime").isNull() & F.col("segments").isNull())
        files = rows.groupBy("file").agg(F.max(bad).alias("bad"), F.max(F.substring("_corrupt_record", 1, 80)).alias("text"))
        state = lambda what, n, why, step: [F.lit(what).alias("state") if isinstance(what, str) else what.alias("state"), n.alias("n_rows"), why.alias("reason"), F.lit(number).cast("long").alias("batch"), F.lit(step).alias("step")]
        none = F.lit(None)
        _write(files.select("file", *state("in progress", none.cast("long"), none.cast("string"), 1)), f"{out}/status/batch={number}/step=1")
        good = rows.join(files.where("NOT bad").select("file"), "file", "left_semi")
        told = transcript_rows(good.withColumn("descriptor", F.coalesce("descriptor", F.lit("")))).withColumn("day", F.to_date("utterance_ts_utc"))
        _write(told, f"{out}/rows/batch={number}")
        between(number)
        counts = good.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        ended = files.join(counts, "file", "left")
        what = F.when(F.col("bad"), "skipped").otherwise("done")
        why = F.when(F.col("bad"), F.concat(F.lit("not a document: "), F.coalesce("text", F.lit(""))))
        _write(ended.select("file", *state(what, F.coalesce("n", F.lit(0)), why, 2)), f"{out}/status/batch={number}/step=2")
        rows.unpersist()

    with many_folders(spark):
        query = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def status(spark: SparkSession, inbox: str, out: str) -> DataFrame:
    """Each file of the inbox, or that was in it, with its last state; waiting if no batch has taken it."""
    with many_folders(spark):
        there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inbox).select(F.col("path").alias("file")) if exists(spark, inbox) else spark.createDataFrame([], "file string")
    if exists(spark, f"{out}/status"):
        told = spark.read.schema(STATUS).parquet(f"{out}/status")
        last = told.groupBy("file").agg(F.max_by(F.struct("state", "n_rows", "reason", "batch"), F.struct("batch", "step")).alias("x")).select("file", "x.*")
    else:
        last = spark.createDataFrame([], "file string, state string, n_rows long, reason string, batch long")
    return there.join(last, "file", "full").withColumn("state", F.coalesce("state", F.lit("waiting")))


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The rows of batches that are over."""
    over = spark.read.schema(STATUS).parquet(f"{out}/status").where("step = 2").select("batch").distinct()
    return spark.read.parquet(f"{out}/rows").join(over, "batch", "left_semi").drop("batch")

"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on doc_id.

Files hold ascending, non-overlapping ranges of doc_id, rows sorted inside each, in several stripes; a
reader prunes stripes and row groups by the statistics and the Bloom filters of doc_id, and the
stripes of one file are read in parallel, since a split of a file takes the stripes that begin in it.

Defined cases: a null text is empty, so its ids are the end id alone; null doc_ids come first;
rows that share a doc_id are ordered by their text; an empty table gives no rows; other columns
of the input are not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, parts_for, stored, text_bytes
from .tokens import encoder, few_at_once

#: Files whose totals are summed together.
FILES_RUN = 1024
#: row: the row's number inside its file.
ROWS = "doc_id long, row long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(documents: DataFrame, vocab: str, *, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """doc_id and the ids of the whole text with the end id, in the input's order."""

    def run(batches):
        to_ids, row = encoder(vocab, kind), 0
        for batch in batches:
            for docs, texts in few_at_once(batch):
                ids, offsets = to_ids.with_end(texts, end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.arange(row, row + len(texts)), pa.int64()), lists], schema=_ARROW)
                row += len(texts)

    return documents.mapInArrow(run, ROWS)


def write(documents: DataFrame, path: str, vocab: str, *, kind: str = "byte", end_id: int = 0, file_bytes: int = 24 << 20, stripe_bytes: int = 4 << 20, index_stride: int = 1000) -> None:
    """Write the ids of all documents in ascending doc_id order; file_bytes is the expected text of a file, stripe_bytes the room of a stripe (looked at every index_stride rows)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.repartitionByRange(parts_for(text_bytes(docs), file_bytes), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    (
        encode(dealt, vocab, kind=kind, end_id=end_id)
        .write.format("orc")
        .options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_stride), "orc.stripe.size": str(stripe_bytes), "orc.rows.between.memory.checks": str(index_stride), "orc.encoding.strategy": "SPEED", "compression": "zstd"})
        .save(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(ROWS).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """For each row of the files: start (ids of all rows before it), n_tokens and the crc32 of its ids.

    Counts are summed inside each file; whole files, one row for each, are summed in the order of
    their numbers, which is the order of doc_id, in runs of FILES_RUN, and then whole runs.
    """

    def run(batches):
        for batch in batches:
            lists = batch["ids"]
            offsets = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["file"], batch["row"], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = read(spark, path).select("doc_id", number.alias("file"), "row", "ids").mapInArrow(run, "doc_id long, file int, row long, n_tokens long, ids_crc32 long")
    rows = stored(rows, "token-counts")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    totals = totals.withColumn("run", F.floor(F.col("file") / FILES_RUN))
    ahead = lambda c, *by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = totals.groupBy("run").agg(F.sum("tokens").alias("in_run")).select("run", ahead("in_run", F.lit(0), order="run").alias("run_start"))
    starts = totals.withColumn("in_run", ahead("tokens", "run", order="file")).join(runs, "run").select("file", (F.col("run_start") + F.col("in_run")).alias("file_start"))
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(documents: DataFrame, vocab: str, *, kind: str = "byte", end_id: int = 0, **parameters) -> DataFrame:
    spark = documents.sparkSession
    path = fresh_path(spark, "tokens-orc")
    write(documents, path, vocab, kind=kind, end_id=end_id, **parameters)
    return digests(spark, path)

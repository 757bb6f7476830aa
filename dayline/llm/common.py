"""What the operators share: the shared folder, written tables, and sizes of inputs."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; what lies between is a word.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where the session names none, a temporary folder is made and set in local mode (tests); on a
    cluster, whose executors could not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dayline-"))
            current = spark.sparkContext.getCheckpointDir()
        return current
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_RELEASED = [0.0]


def release(seconds: float = 1.0) -> None:
    """In a worker, at the end of a task or group: what it has freed goes back to the system, unless it did so just now.

    Workers are kept for later stages with all that their allocators hold, beside the stage's own needs.
    """
    if time.monotonic() - _RELEASED[0] >= seconds:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)
        _RELEASED[0] = time.monotonic()


def unused(name: str, *taken: str) -> str:
    """name, with as many underscores as no taken column's name has (Spark takes names of either case for equal)."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, for choosing how many parts to deal rows to."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


#: Bytes of a text that a fitting sample takes at most; longer ones are scored, but nothing is fitted on them.
MAX_TEXT = 1 << 20


def sampled(rows: DataFrame, order: list[str | Column], max_bytes: int, max_text: int = MAX_TEXT) -> DataFrame:
    """Of a sample's rows (a bounded number, with a column text): the first by order whose texts hold max_bytes together, in that order.

    A text over max_text takes no part, nor does it count against the others, so the rest of the sample
    is at most max_text short of max_bytes. Sizes are summed in one task, without the texts.
    """
    rows = stored(rows.withColumns({"_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "_row": F.monotonically_increasing_id()}), "sample")
    names = [c for c in rows.columns if c not in ("text", "_size", "_row")]
    by = Window.orderBy("_at", "_row")
    sizes = rows.where(F.col("_size") <= max_text).select("_row", "_size", F.struct(*order).alias("_at") if order else F.lit(0).alias("_at"))
    first = sizes.withColumn("_sum", F.sum("_size").over(by)).withColumn("_place", F.row_number().over(by)).where(F.col("_sum") <= max_bytes).select("_row", "_place")
    return rows.join(F.broadcast(first), "_row").orderBy("_place").select("text", *names)  # as many rows as the sample


def parts_for(n_bytes: int, part_bytes: int) -> int:
    return max(1, -(-n_bytes // part_bytes))


def part_of(n_parts: int, *columns: str | Column) -> Column:
    """A part number from the row's own values: the same on every attempt."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_parts)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


ASCII_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

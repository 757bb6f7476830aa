"""JSON documents, line sets, partitions of days and audio archives."""

from __future__ import annotations

import io
import tempfile
import uuid
import wave
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share, spark.checkpoint.dir; in local mode a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="dayline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written once to the shared folder and read back: both sides of a plan see the same rows, and a lost executor loses nothing. The files go when the application ends."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def many_folders(spark: SparkSession):
    """Inside, folders are listed by few tasks. Spark lists each of up to 10,000 folders by a task of its own, of which every one unpacks the file system's settings."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_tasks(rows: DataFrame) -> DataFrame:
    """rows of very many small files, read by 16 tasks a core. Spark counts 4 MB for opening a file, so 32 files are a task; this puts such tasks together and cuts none."""
    return rows.coalesce(16 * rows.sparkSession.sparkContext.defaultParallelism)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one object or an array each, with the name of their file."""
    with many_folders(spark):
        rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return few_tasks(rows.select("*", F.col("_metadata.file_name").alias("_file")))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_documents, or no rows if the path isn't there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("multiLine", True).schema(schema).json(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Characters that a folder of a partition shows as % and two hexadecimal digits, % first.
_ESCAPED = ["%", *map(chr, range(1, 32)), *"\"#'*/:=?\\{[]^\x7f"]


def partition_folder(key: str) -> Column:
    """The name of the folder that Spark reads as a partition of the value of the column key."""
    shown = F.col(key).cast("string")
    escaped = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}")), _ESCAPED, shown)
    safe = F.when(shown.rlike(r"^[\w .,+-]*$"), shown).otherwise(escaped)
    return F.concat(F.lit(f"{key}="), F.coalesce(F.nullif(safe, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_each(docs: DataFrame, path: str, key: str) -> None:
    """The text in value as one file below the folder of its key, for each row; no two rows may share a key. What was there goes.

    Files by the million: tasks write and move them (sources.documents), since Spark's own writer takes some
    milliseconds for each on the executor, and its commit some more on the driver.
    """
    from .documents import DocumentSource

    spark = docs.sparkSession
    spark.dataSource.register(DocumentSource)
    delete(spark, path)
    docs.select(partition_folder(key).alias("folder"), F.lit("part-00000.txt").alias("name"), "value").write.format("day_documents").mode("append").option("path", path).save()


def write_array(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One JSON array for each key, in order, below folders of the key."""
    names = [c for c in rows.columns if c != key]
    lists = F.sort_array(F.collect_list(F.struct(*order, F.struct(*names).alias("_row"))))
    docs = rows.groupBy(key).agg(F.to_json(F.transform(lists, lambda x: x["_row"]), {"ignoreNullFields": "false"}).alias("value"))
    write_each(docs, path, key)


def write_days(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows below year=/month=/day= of their column date; days that rows have are replaced, others stay."""
    day = F.to_date("date")
    parts = rows.withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")})
    parts.repartition("year", "month", "day").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("year", "month", "day").format(fmt).save(path)


def write_months(rows: DataFrame, path: str, month: str) -> None:
    """Element sets below month=, epochs in UTC with their zone."""
    shown = rows.withColumn("epoch", F.date_format("epoch", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    shown.repartition(month).sortWithinPartitions(month, "epoch").write.mode("overwrite").partitionBy(month).json(path)


def manifest(days: DataFrame, photos: DataFrame, key: str = "date") -> DataFrame:
    """Every day with its photos in order, an empty list if it has none."""
    from ..operators.joins import beside_days

    return beside_days(days, key, images=photos.select(key, F.struct(*[c for c in photos.columns if c != key]).alias("image")))


def available_days(rows: DataFrame) -> DataFrame:
    """date: the days of partition columns year, month and day."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return rows.select(F.concat_ws("-", pad("year", 4), pad("month", 2), pad("day", 2)).alias("date")).distinct()


def line_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def track(status: DataFrame, add: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """A line set with lines added once, and others taken out."""
    if add is not None:
        status = status.unionByName(add).distinct()
    return status if drop is None else status.join(drop, "value", "left_anti")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Zip files of a folder, whatever the case of their suffix, newest first by the date in their names; their contents are not read."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return _zips(spark, folder).select("path", name.alias("name"), times.archive_date(name).alias("date"), "length").orderBy(F.desc("date"), F.desc("name"))


def _zips(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where(F.endswith(F.lower("path"), F.lit(".zip")))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Sound files of a folder's archives whose own date is the archive's: archive, date, name, date_time, channel and content. Members are read one by one, those that can't be have no row."""
    from . import zips

    found = zips.index(spark, folder).withColumn("archive", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.endswith(F.lower("name"), F.lit(".wav")))
    found = found.withColumns({"date": times.archive_date(F.col("archive")), "r": T.recording_name(F.regexp_extract("name", r"([^/]+)$", 1))}).where("r IS NOT NULL")
    found = found.where(F.substring("r.date_time", 1, 10) == F.col("date")).select("path", "name", "offset", "packed", "method", "crc", "error", "archive", "date", F.col("r.date_time").alias("date_time"), F.col("r.channel").alias("channel"))
    return zips.contents(found).where("content IS NOT NULL").select("archive", "date", "name", "date_time", "channel", "content")


def noise_floor(rms: np.ndarray, around: int = 250) -> np.ndarray:
    """The noise that each frame stands in, from stretches of `around` frames: the tenth percentile of a stretch's loudness, the middle one of its own, the last and the next stretch's, so that neither a stretch of speech nor a change of the channel's noise misleads it."""
    n = len(rms)
    parts = np.array([np.percentile(rms[at : at + around], 10) for at in range(0, n, around)])
    beside = np.concatenate([parts[:1], parts, parts[-1:]])
    middle = np.median([beside[:-2], parts, beside[2:]], axis=0)
    return np.repeat(middle, around)[:n]


def wav_frames(sounds: DataFrame, frame_ms: int = 20, above: float = 3.0, least: float = 60.0) -> DataFrame:
    """20 ms frames of sound files: file, frame_no from 1, is_speech: louder than `above` times the noise floor around it, and than `least`.

    A short last frame is dropped; sound that is not of 16 bits and one channel is silent; a file that can't be read as sound, or is null, has no frames.
    """

    def scan(frames):
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content or b"")) as w:
                        n, width = int(w.getframerate() * frame_ms / 1000), w.getsampwidth() * w.getnchannels()
                        raw = w.readframes(w.getnframes())
                except (wave.Error, EOFError):
                    continue
                full = len(raw) // (n * width)
                if width == 2 and full:
                    x = np.frombuffer(raw[: full * n * 2], dtype="<i2").reshape(full, n).astype(float)
                    rms = np.sqrt((x**2).mean(axis=1))
                    voiced = rms > np.maximum(least, above * noise_floor(rms))
                else:
                    voiced = np.zeros(full, dtype=bool)
                yield pd.DataFrame({"file": name, "frame_no": np.arange(1, full + 1, dtype="int32"), "is_speech": voiced})

    return sounds.select("name", "content").mapInPandas(scan, "file string, frame_no int, is_speech boolean")

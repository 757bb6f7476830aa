"""Headerless pipe-delimited text: raw splitting, no quotes, a fixed number of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of the two files.
TRANSCRIPT = ["utteranceTime", "filename", "start", "end", "language", "text", "textOriginalLang"]
RECORDINGS = ["startTime", "videoId", "duration", "title"]


def line(*columns: str) -> Column:
    """Fields in order between pipes; nulls are empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def parse(lines: DataFrame, names: list[str], *, at_least: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of lines (column value) with the right number of fields, and the other lines; empty ones are neither."""
    fields = F.split("value", "[|]", -1)
    fits = F.size(fields) >= len(names) if at_least else F.size(fields) == len(names)
    rest = [c for c in lines.columns if c != "value"]
    lines = lines.where("value <> ''")
    return lines.where(fits).select(*rest, *[fields[i].alias(n) for i, n in enumerate(names)]), lines.where(~fits)


def read(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both parts of parse() over text files, with their partition columns."""
    return parse(spark.read.text(path), names)


def write(rows: DataFrame, path: str, names: list[str], partitions: list[str] = (), order: list[str] = (), mode: str = "overwrite") -> None:
    """One folder for each partition; rows in order inside it."""
    if order:
        rows = rows.repartition(*partitions).sortWithinPartitions(*partitions, *order) if partitions else rows.sort(*order)
    rows.select(*partitions, line(*names).alias("value")).write.mode(mode).partitionBy(*partitions).text(path)


def recording_days(spark: SparkSession, path: str) -> DataFrame:
    """date: the days of the first fields."""
    first = F.split("value", "[|]", -1)[0]
    return spark.read.text(path).select(F.split(first, "T")[0].alias("date")).where("date <> ''").distinct()

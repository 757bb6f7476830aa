"""The archive's own plans: daily transcripts, and all that is known of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..functions import times
from ..operators import aggregates, joins, kept
from ..sources import days, pipe


def transcript_rows(utterances: DataFrame) -> DataFrame:
    """Raw utterances to transcript rows: UTC time of day, first start, last end, joined texts; worthless ones go. The full UTC time stands beside."""
    said = T.joined_segments(F.col("segments"))
    rows = utterances.where(~said.isin(*T.WORTHLESS))
    return rows.select(
        *[c for c in ("year", "month", "day") if c in utterances.columns], times.utc_time_of_day(F.col("utteranceTime")).alias("utteranceTime"),
        T.swap_extension(F.coalesce("filename", F.lit("")), "json", "aac").alias("filename"), T.first_start(F.col("segments")).alias("start"), T.last_end(F.col("segments")).alias("end"),
        F.coalesce("language", F.lit("en")).alias("language"), said.alias("text"), T.joined_segments(F.col("origLangSegments")).alias("textOriginalLang"), times.wall_clock_to_utc(F.col("utteranceTime")).alias("utterance_ts_utc"),
    )


def photo_manifest(records: DataFrame, order: list[str]) -> DataFrame:
    """Photo records to one row for each photo that has both sizes."""
    given = records.where(T.all_given(*[F.col(c) for c in ("mission", "roll", "frame", "pdate", "ptime", "directory", "filename")]))
    size = F.when(F.contains("directory", F.lit("/large/")), "large").when(F.contains("directory", F.lit("/small/")), "small")
    sized = given.withColumn("size", size).where("size IS NOT NULL").withColumn("url", F.concat(F.col("directory"), F.lit("/"), F.col("filename")))
    wide = aggregates.pivot_last(sized, ["mission", "roll", "frame"], "size", ["small", "large"], "url", order, first=["pdate", "ptime"])
    both = wide.where("small IS NOT NULL AND large IS NOT NULL")
    return both.select(F.concat_ws("-", "mission", "roll", "frame").alias("ID"), times.compact_time(F.col("pdate"), F.col("ptime")).alias("dateTaken"), F.col("small").alias("smallUrl"), F.col("large").alias("largeUrl"))


def day_view(dates: DataFrame, *, transcripts: DataFrame, images: DataFrame, recordings: DataFrame, spacewalks: DataFrame, crew: DataFrame, expeditions: DataFrame) -> DataFrame:
    """One row for each date (text): arrays of what the sources have for it, empty where they have nothing, and its expedition.

    transcripts and images have a column date; recordings start with it in startTime, spacewalks in startTime; crew are those aboard.
    """
    item = lambda rows, *drop: F.struct(*[c for c in rows.columns if c not in drop]).alias("item")
    recordings = recordings.withColumn("date", F.substring("startTime", 1, 10))
    spacewalks = spacewalks.withColumn("date", F.date_format("startTime", "yyyy-MM-dd"))
    dated = dates.select("date", times.checked_day(F.col("date")).alias("_d"))
    aboard = joins.onboard(dated.select(F.col("_d").alias("date")), crew)
    aboard = aboard.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.struct(*crew.columns).alias("item"))
    view = joins.beside_days(
        dates, "date", transcripts=transcripts.select("date", item(transcripts, "date")), images=images.select("date", item(images, "date")),
        recordings=recordings.select("date", item(recordings, "date")), spacewalks=spacewalks.select("date", item(spacewalks, "date")), crew=aboard,
    )
    first = joins.first_covering(dated.where("_d IS NOT NULL"), _terms(expeditions), "_d", "_start", "_end", "expedition")
    first = first.select("date", F.struct(*expeditions.columns).alias("expedition"))
    return view.join(first, "date", "left")


def _terms(expeditions: DataFrame) -> DataFrame:
    """expeditions with the days from _start to _end. Texts compare as texts do: one without a date that begins behind all digits, as a word does, has no end; a missing start or end covers nothing."""
    day = lambda c: F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.when(F.col(c) >= ":", F.lit("9999-12-31").cast("date")))
    found = expeditions.withColumns({"_start": day("start"), "_end": day("end")})
    return found.where("_start IS NOT NULL AND _end IS NOT NULL").withColumns({c: F.col(c).cast("timestamp") for c in ("_start", "_end")})


def day_view_of_files(spark: SparkSession, root: str, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The day view of the dates from the files below root (sources.days), and the quarantine: a missing source is empty, a damaged one empties its days."""
    json = {"images": schemas.IMAGE, "spacewalks": schemas.SPACEWALK, "crew": schemas.STAY, "expeditions": schemas.EXPEDITION}
    found = days.load(spark, root, json=json, lines={"transcripts": pipe.TRANSCRIPT, "recordings": pipe.RECORDINGS})
    t = {n: x.withColumnRenamed("scope", "date") if n in ("transcripts", "images") else x.drop("scope") for n, x in found.tables.items()}
    return found.blanked(day_view(dates, **t)), found.quarantine


def kept_photos(spark: SparkSession, path: str, order: list[str]) -> kept.Kept:
    """The photo manifest kept up to date by the days of photos; the records of one photo share their day."""
    size = lambda name: F.contains("directory", F.lit(f"/{name}/"))
    url = F.concat(F.col("directory"), F.lit("/"), F.col("filename"))
    values = {"small": ("last", url, size("small") & ~size("large")), "large": ("last", url, size("large")), "ptime": ("first", F.col("ptime"), size("large") | size("small"))}
    return kept.Kept(spark, path, keys=["pdate", "mission", "roll", "frame"], part="pdate", order=order, values=values)


def given_photos(records: DataFrame) -> DataFrame:
    return records.where(T.all_given(*[F.col(c) for c in ("mission", "roll", "frame", "pdate", "ptime", "directory", "filename")]))


def photos_of(state: DataFrame) -> DataFrame:
    """The manifest's rows of what kept_photos() holds."""
    both = state.where("small IS NOT NULL AND large IS NOT NULL")
    return both.select(F.concat_ws("-", "mission", "roll", "frame").alias("ID"), times.compact_time(F.col("pdate"), F.col("ptime")).alias("dateTaken"), F.col("small").alias("smallUrl"), F.col("large").alias("largeUrl"))


def seed_clock(param: str | None, first_item: str | None) -> str | None:
    """The clock's start: transcripts beat the address's time."""
    return first_item or param

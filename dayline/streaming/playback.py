"""The day as it plays: each tick of the clock with what stands at that moment, as a join of a stream with static tables.

Hours are cut to equal slots, so many that a slot has few items however dense an hour is. What a moment can need of a
source lies in one row for its slot: the slot's own items in order, the last item before it, and the first behind it. So a tick meets
its hour's number of slots and one row of each source by equality, picks in that row's short arrays, and no state is
kept; a batch of the same ticks gives the same rows. Items that crowd in a small part of an hour share slots, and each tick there looks at all of its slot.

Defined cases: before the first item there is none (null); items of one moment: the last by their columns counts for
`latest`, the first for `nearest`; of two items as near, the earlier; ticks beyond all items of a source still have
their last one if their hour lies between the first and the last hour of `hours`; a tick with a null time has nulls; items with a null time are nobody's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators.scans import unused


#: Items that a slot has on average, at most.
EACH = 16
HOUR = 3_600_000_000


def slot_of(at: Column, hour: Column, slots: Column) -> Column:
    """The number of the slot of at, of so many equal slots of its hour."""
    return F.floor((F.unix_micros(at) - F.unix_micros(hour)) * slots / F.lit(HOUR)).cast("long")


def by_slot(items: DataFrame, at: str, hours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hours, each with its number of slots (so many that a slot has EACH items on average), and their slots: hour, slot, the items in it, sorted, the last before it and the first behind it; items are structs of at and the other columns.

    Every hour of items is an hour too. Slots are as many as hours and a part of the items, also where an hour has ever more items.
    """
    whole = F.struct(F.col(at).cast("timestamp").alias("at"), *[c for c in items.columns if c != at])
    own = items.where(F.col(at).isNotNull()).select(F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour"), whole.alias("item"))
    least, most = F.min("item").alias("least"), F.max("item").alias("most")
    counted = own.groupBy("hour").agg(F.ceil(F.count(F.lit(1)) / F.lit(EACH)).alias("slots"), least, most)
    line = Window.orderBy("hour")  # one row an hour, so a century is under a million rows
    rows = hours.select("hour").distinct().join(counted, "hour", "full")
    before = F.last("most", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("least", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    plan = rows.select("hour", F.coalesce("slots", F.lit(1)).alias("slots"), before.alias("before"), behind.alias("behind"))

    own = own.join(plan.select("hour", "slots"), "hour").withColumn("slot", slot_of(F.col("item.at"), F.col("hour"), F.col("slots")))
    own = own.groupBy("hour", "slot").agg(F.sort_array(F.collect_list("item")).alias("items"))
    every = plan.select("hour", "before", "behind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    rows, line = every.join(own, ["hour", "slot"], "left"), Window.partitionBy("hour").orderBy("slot")
    last = F.last(F.element_at("items", -1), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.element_at("items", 1), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    return plan.select("hour", "slots"), rows.select("hour", "slot", F.coalesce("items", F.array()).alias("items"), F.coalesce(last, "before").alias("before"), F.coalesce(first, "behind").alias("behind"))


def hours_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The hours from the one of first to the one of last, both UTC times."""
    return spark.sql(f"SELECT explode(sequence(date_trunc('hour', TIMESTAMP'{first}'), date_trunc('hour', TIMESTAMP'{last}'), INTERVAL 1 HOUR)) AS hour")


def latest(t: Column, row: Column) -> Column:
    """The last item at or before t."""
    upto = F.filter(row["items"], lambda x: x["at"] <= t)
    return F.when(t.isNull(), None).when(F.size(upto) > 0, F.element_at(upto, -1)).otherwise(row["before"])


def nearest(t: Column, row: Column) -> Column:
    """The item nearest to t, the earlier of two as near."""
    away = lambda x: F.abs(F.unix_micros(x["at"]) - F.unix_micros(t))
    near = F.concat(row["items"], F.array_compact(F.array(row["before"], row["behind"])))
    best = F.array_min(F.transform(near, lambda x: F.struct(away(x).alias("away"), x.alias("item"))))
    return F.when(t.isNotNull(), best["item"])


def playing(ticks: DataFrame, hours: DataFrame, *, latest_of: dict[str, tuple[DataFrame, str]] | None = None, nearest_to: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """ticks (a stream or a table with a timestamp column at) with a struct column for each source (its rows, the name of their time column): its latest item, or its nearest."""
    hour, slots, slot = unused(ticks, "hour_of", "slots_of", "slot_of")
    out = ticks.withColumn(hour, F.date_trunc("hour", "at"))
    for pick, sources in ((latest, latest_of or {}), (nearest, nearest_to or {})):
        for name, (items, at) in sources.items():
            rest = [c for c in items.columns if c != at]  # of one moment one item: else a moment that many share is in the row of each tick near it
            one = F.max(F.struct(*rest)) if pick is latest else F.min(F.struct(*rest))
            items = items.groupBy(at).agg(one.alias("item")).select(at, "item.*")
            plan, rows = by_slot(items, at, hours)
            plan = plan.select(F.col("hour").alias(f"{hour}_"), F.col("slots").alias(slots))
            rows = rows.select(F.col("hour").alias(f"{hour}_"), F.col("slot").alias(f"{slot}_"), F.struct("items", "before", "behind").alias(name))
            out = out.join(plan, F.col(hour) == F.col(f"{hour}_"), "left").drop(f"{hour}_").withColumn(slot, slot_of(F.col("at"), F.col(hour), F.col(slots)))
            out = out.join(rows, (F.col(hour) == F.col(f"{hour}_")) & (F.col(slot) == F.col(f"{slot}_")), "left").drop(f"{hour}_", f"{slot}_", slots, slot)
            out = out.withColumn(name, pick(F.col("at"), F.col(name)))
    return out.drop(hour)


def clock(spark: SparkSession, start: str, started_ms: int, per_second: int = 2) -> DataFrame:
    """Ticks of the playback clock: timestamp, and clock, the time of day that it shows."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select("timestamp", times.playback_clock(F.lit(start), F.lit(started_ms), F.unix_millis("timestamp")).alias("clock"))


def on_day(ticks: DataFrame, day: str) -> DataFrame:
    """Ticks of the clock with at, the moment (UTC) that it shows, counted from the day's beginning: hours beyond 23 are the next day's."""
    whole, parts = F.substring_index("clock", ".", 1), F.substring_index("clock", ".", -1)
    ms = times.hms_seconds(whole).cast("long") * 1000 + F.when(F.contains("clock", F.lit(".")), parts.try_cast("long")).otherwise(F.lit(0))
    return ticks.withColumn("at", F.timestamp_millis(F.unix_millis(F.lit(day).cast("date").cast("timestamp")) + ms))

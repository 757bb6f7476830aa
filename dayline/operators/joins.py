"""Interval, as-of, existence and lookup joins.

Defined cases, where a function states no others: null keys meet nothing, as in SQL, and a missing key has no flag, so
its flags are false; repeated rows of the left side come back as often as they occur, and repeated rows of sets
(flags, todo, copy_plan) change nothing; of a name given twice lookup() returns both; empty tables give
what an empty set gives; the rows' own columns come back as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import MOST, Slices, unused


#: A node of the tree over time has 2 ** BITS children.
BITS = 2


class _Tree:
    """A segment tree over the units of time (microseconds, or days if points are dates) from the first point to the last.

    An interval is the union of few nodes, at most 2 * (2 ** BITS - 1) a level, and a point lies in one node of each
    level, so point and interval share exactly one node if one covers the other, and else none.
    """

    def __init__(self, points: DataFrame, at: str):
        self.days = points.schema[at].dataType.typeName() == "date"
        self.at = self._unit(at)
        edges = points.agg(F.min(self.at).alias("low"), F.max(self.at).alias("high")).first()
        self.low, self.high = (0, -1) if edges["low"] is None else (edges["low"], edges["high"])
        self.levels = max(1, -(-(self.high - self.low + 1).bit_length() // BITS) + 1)

    def _micros(self, column: str) -> Column:
        return F.unix_micros(F.col(column).cast("timestamp"))

    def _unit(self, column: str, *, up: bool = False) -> Column:
        """The unit that a time lies in, or the first that begins at it or after it."""
        if not self.days:
            return self._micros(column)
        day, micros = F.lit(86_400_000_000), self._micros(column) + (86_400_000_000 - 1 if up else 0)
        return ((micros - F.pmod(micros, day)) / day).cast("long")

    def of_points(self) -> Column:
        """The nodes above a point, level by level: node number times 64 and the level."""
        at = self.at - F.lit(self.low)
        return F.array(*[F.shiftleft(F.shiftright(at, BITS * n), 6) + n for n in range(self.levels)])

    def span(self, start: str, end: str) -> tuple[Column, Column]:
        """The tree's units that an interval covers, counted from the first point: the first one and the one behind the last. A null start is the beginning of time."""
        first = F.greatest(F.coalesce(self._unit(start, up=True), F.lit(self.low)), F.lit(self.low)) - self.low
        return first, F.least(self._unit(end), F.lit(self.high)) - self.low + 1

    def of_intervals(self, start: str, end: str) -> Column:
        """The nodes that an interval is made of; none if no point's unit can be in it. A null end never covers."""
        first, last = self.span(start, end)
        return F.when(F.col(end).isNotNull() & (first < last), self.of_span(first, last))

    def of_span(self, first: Column, last: Column) -> Column:
        """The nodes that the units from first to before last are made of."""
        up = lambda n: F.shiftright(first + (1 << BITS * n) - 1, BITS * n)
        down = lambda n: F.shiftright(last, BITS * n)

        def span(low: Column, high: Column, n: int) -> Column:
            nodes = F.transform(F.sequence(low, high - 1), lambda x: F.shiftleft(x, 6) + n)
            return F.when(low < high, nodes).otherwise(F.array().cast("array<long>"))

        parts = []
        for n in range(self.levels):
            inner = up(n + 1) < down(n + 1)  # what the level above takes
            left = F.when(inner, F.shiftleft(up(n + 1), BITS)).otherwise(down(n))
            parts.append(F.when(up(n) < down(n), F.concat(span(up(n), left, n), F.when(inner, span(F.shiftleft(down(n + 1), BITS), down(n), n)).otherwise(F.array().cast("array<long>")))))
        return F.flatten(F.array_compact(F.array(*parts)))


def covering(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each point with the intervals that cover it, both ends included: point columns, then interval columns.

    A null start is the beginning of time, a null end never covers, a null at is never covered; equal rows
    count as often as they occur. Both sides meet in the nodes of a segment tree over time, by equality
    alone: no bucket is wide, and no pair is formed that is not in the result. A node that many points or
    intervals share is a skewed key of an inner join, which adaptive execution splits.
    """
    tree = _Tree(points, at)
    asked, dealt = unused(points, "asked")[0], unused(intervals, "dealt")[0]
    own = points.withColumn(asked, F.explode(tree.of_points()))
    theirs = intervals.withColumn(dealt, F.explode(tree.of_intervals(start, end)))
    return own.join(theirs, F.col(asked) == F.col(dealt)).drop(asked, dealt)


def onboard(dates: DataFrame, crew: DataFrame) -> DataFrame:
    """Of each date (column date, at midnight UTC): the crew members whose stay covers it."""
    return covering(dates, crew, "date", "arrivalDate", "departureDate")


def first_covering(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, order: str) -> DataFrame:
    """Each point that is covered with the first interval by order, then by its other columns: point columns, then interval columns.

    As covering(), but no pairs form. The least value of order is found alone, for each span of units, then
    for each node of the tree and each time, which asks its nodes, one a level: numbers and times are combined in
    hash tables before each shuffle, so a task holds the spans it met, not its intervals' nodes. Whole rows, which
    Spark would sort to combine, are then dealt to nodes only of intervals whose value is the least of some time, or null.
    """
    tree = _Tree(points, at)
    (time, node), (first, last, least) = unused(points, "time", "node"), unused(intervals, "first", "last", "least")
    times = points.select(tree.at.alias(time), tree.of_points().alias(node)).where(F.col(time).isNotNull()).distinct()
    asked = times.select(time, F.explode(node).alias(node))

    begun, ended = tree.span(start, end)
    spans = intervals.where(F.col(end).isNotNull() & (begun < ended)).groupBy(begun.alias(first), ended.alias(last)).agg(F.min(order).alias(least))
    dealt = spans.select(F.explode(tree.of_span(F.col(first), F.col(last))).alias(node), least).groupBy(node).agg(F.min(least).alias(least))
    leasts = asked.join(dealt, node).groupBy(time).agg(F.min(least).alias(least)).select(least).where(F.col(least).isNotNull()).distinct()
    near = intervals.join(leasts, F.col(order) == F.col(least), "left").where(F.col(least).isNotNull() | F.col(order).isNull()).drop(least)

    rest = [c for c in intervals.columns if c != order]
    best = lambda c: F.min_by(c, F.struct(c[order], *[c[x] for x in rest]))
    kept = near.select(F.explode(tree.of_intervals(start, end)).alias(node), F.struct(*intervals.columns).alias("kept"))
    kept = kept.groupBy(node).agg(best(F.col("kept")).alias("kept"))
    found = asked.join(kept, node).groupBy(time).agg(best(F.col("kept")).alias("kept"))
    found = found.withColumnRenamed("kept", node)
    met = points.withColumn(time, tree.at).join(found, time)
    return met.select(*points.columns, f"{node}.*")


def nearest(left: DataFrame, right: DataFrame, *, by: list[str], at: str, epoch: str, order: list[str], payload: list[str], most: int = MOST) -> DataFrame:
    """Each left row with payload columns of the right row of the same key whose epoch is nearest; ties go to the earlier epoch, then to the first by order.

    Both sides are laid out in one order of time; the row before is carried forwards and the row after
    backwards, so no pairs form. Keys of more than `most` rows, both sides together, are scanned in slices.
    A null key meets none, as in an SQL join, and a left row with a null key or time has null payload;
    a right row with a null epoch is nobody's. Repeated left rows come back as often as they occur.
    """
    given = lambda names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    keys = [f"k{n}" for n in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    picked = F.struct(F.col(epoch).alias("t"), *[F.col(c).alias(f"p{n}") for n, c in enumerate(payload)])
    first = right.where(given([*by, epoch])).groupBy(*named, F.col(epoch).alias("t")).agg(F.min_by(picked, F.struct(*order)).alias("r"))
    rows = left.where(given([*by, at])).select(*named, F.col(at).alias("t"), F.struct(*left.columns).alias("l"), F.lit(None).cast(first.schema["r"].dataType).alias("r"), F.lit(1).alias("side"))
    both = rows.unionByName(first.select(*keys, "t", F.lit(None).cast(rows.schema["l"].dataType).alias("l"), "r", F.lit(0).alias("side")))
    scan = Slices(both, keys, ["t", "side"], most)
    scan.last(F.col("r"))
    before = scan.made
    scan.last(F.col("r"), backwards=True)
    before, after = F.col(before), F.col(scan.made)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    to_before, to_after = micros(F.col("t")) - micros(before["t"]), micros(after["t"]) - micros(F.col("t"))
    best = F.when(after.isNull() | (to_before <= to_after), F.coalesce(before, after)).otherwise(after)
    found = scan.rows.where("side = 1").withColumn("x", best).select("l.*", *[F.col(f"x.p{n}").alias(c) for n, c in enumerate(payload)])
    lone = left.where(~F.coalesce(given([*by, at]), F.lit(False))).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload])
    return found.union(lone)


def flags(dates: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """A boolean for each source: whether it has the key."""
    for name, source in sources.items():
        known = source.select(F.col(source.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
        dates = dates.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return dates


def todo(every: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the done sets."""
    return reduce(lambda rows, d: rows.join(d.select(F.col(d.columns[0]).alias(key)), key, "left_anti"), done, every)


def copy_plan(wanted: DataFrame, there: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose file is there and not yet in the target."""
    return wanted.join(there.select(key), key, "left_semi").join(target.select(key), key, "left_anti")


def lookup(rows: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """rows with the name of their code, or the code itself."""
    (known,) = unused(rows, "known")
    return rows.join(names.select(F.col(code).alias(known), F.col(name)), F.col(code) == F.col(known), "left").drop(known).withColumn(name, F.coalesce(name, code))


def padded_months(rows: DataFrame, months: DataFrame, day: str, month: str) -> DataFrame:
    """Each month (its first day) with the rows from its day before to the second day of the next month; rows at the seams come for both.

    A row can only belong to its own month and the two beside it, so the join is by month.
    """
    from ..functions.times import padded_month

    own, (near,) = F.trunc(F.col(day), "MM"), unused(rows, "near")
    dealt = rows.withColumn(near, F.explode(F.array(F.add_months(own, -1), own, F.add_months(own, 1))))
    low, high = padded_month(F.col(month))
    return months.join(dealt, F.col(month) == F.col(near)).where((F.col(day) >= low) & (F.col(day) <= high)).drop(near)


def ladder(candidates: DataFrame, found: DataFrame, key: str, by: str, rank: str, value: str) -> DataFrame:
    """Of each by, the value of the first candidate by rank that is found."""
    hits = candidates.join(found.select(key, value), key)
    return hits.groupBy(by).agg(F.min_by(value, F.struct(rank, key, value)).alias(value))


def beside_days(days: DataFrame, key: str, **sources: Column | DataFrame) -> DataFrame:
    """Each day with one array column for each source (a DataFrame of key and item), sorted, empty if it has none."""
    for name, source in sources.items():
        item = [c for c in source.columns if c != key][0]
        lists = source.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
        empty = F.array().cast(lists.schema[name].dataType)
        days = days.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return days

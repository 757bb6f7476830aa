"""Row-after-row scans that no single key can hold up: hot keys are cut to slices in order, and slices meet at their seams.

A window puts all rows of a key in one task. Here the keys with more than `most` rows are found by a count
and dealt by ranges of (key, order) to slices of about that many rows; all other keys stay whole. Then

1. each slice is scanned by itself, a window over (key, slice);
2. each slice gives one row, what it hands on; these few rows (as many as slices) are scanned in order;
3. each slice's rows are finished with what the slices before hand on.

Without a hot key nothing is cut, and the plan is the plain window. The slices of hot keys are a written
table, so that both passes see the same ones, also after an executor is lost.

Defined cases: null keys are equal to each other; nulls come first in an order, as in windows; rows that are
equal in their order are neighbours in any order among themselves; an empty table gives no rows; columns may
have any names, since those made on the way get names of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: Rows of a slice, and of a key that stays whole.
MOST = 1 << 20


def unused(rows: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores as make it new to rows (Spark takes names of either case for equal)."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


class Slices:
    """rows with a slice number beside their keys: 0 for keys of at most `most` rows, from 1 in order of `order` for others."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], most: int = MOST):
        (self.part,) = unused(rows, "part")
        self.keys, self.order = keys, order
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(self.part)).where(F.col(self.part) > most)
        hot = counts.collect()  # at most as many keys as the table has times `most` rows
        self.hot = bool(hot)
        if not hot:
            self.rows = rows.withColumn(self.part, F.lit(0))
            return
        n = sum(-(-r[self.part] // most) for r in hot)
        known = F.broadcast(rows.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], rows.select(*keys).schema))
        sliced = rows.join(known, same(rows, known, keys), "left_semi").repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *[F.col(c).asc_nulls_first() for c in order])
        sliced = stored(sliced.withColumn(self.part, F.spark_partition_id() + 1), "slices")
        self.rows = rows.join(known, same(rows, known, keys), "left_anti").withColumn(self.part, F.lit(0)).unionByName(sliced)
        self.of_hot = sliced

    def line(self, *order: str | Column) -> Window:
        """A window over each key's slice, in order (self.order, or as given)."""
        return Window.partitionBy(*self.keys, self.part).orderBy(*(order or self.order))

    def _handed(self, rows: DataFrame, each: Column, over: Column, name: str) -> DataFrame:
        """rows with, as name, what over (a window function of the column `name` over a key's slices in order) makes of what each slice of a hot key hands on."""
        hands = rows.where(F.col(self.part) > 0).groupBy(*self.keys, self.part).agg(each.alias(name))
        own = unused(rows.withColumn(name, F.lit(0)), *[f"of_{c}" for c in [*self.keys, self.part]])
        hands = hands.select(*[F.col(c).alias(n) for c, n in zip([*self.keys, self.part], own, strict=True)], over.alias(name))
        met = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*self.keys, self.part], own, strict=True)]
        return rows.join(F.broadcast(hands), reduce(lambda a, b: a & b, met), "left").drop(*own)  # as many rows as slices

    def last(self, value: Column, *, upto: int = 0, backwards: bool = False, order: list[str] | None = None) -> None:
        """Adds, as self.made, the last value that is not null up to each row (upto -1: before it); backwards: the first from it on."""
        order = order or self.order
        (made, own, of) = unused(self.rows, "made", "own", "of")
        by = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in order]
        rows = self.rows.withColumn(of, value).withColumn(own, F.last(of, ignorenulls=True).over(self.line(*by).rowsBetween(Window.unboundedPreceding, upto)))
        if self.hot:
            at = F.when(F.col(of).isNotNull(), F.struct(*order))
            each = F.min_by(of, at) if backwards else F.max_by(of, at)
            across = Window.partitionBy(*self.keys).orderBy(F.desc(self.part) if backwards else F.asc(self.part)).rowsBetween(Window.unboundedPreceding, -1)
            rows = self._handed(rows, each, F.last(made, ignorenulls=True).over(across), made)
            rows = rows.withColumn(made, F.coalesce(own, made)).drop(own, of)
        else:
            rows = rows.withColumnRenamed(own, made).drop(of)
        self.rows, self.made = rows, made

    def total(self, value: Column) -> None:
        """Adds, as self.made, the sum of value up to each row."""
        (made, own, of) = unused(self.rows, "made", "own", "of")
        rows = self.rows.withColumn(of, value).withColumn(own, F.sum(of).over(self.line().rowsBetween(Window.unboundedPreceding, 0)))
        if self.hot:
            across = Window.partitionBy(*self.keys).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
            rows = self._handed(rows, F.sum(of), F.sum(made).over(across), made)
            rows = rows.withColumn(made, F.col(own) + F.coalesce(made, F.lit(0))).drop(own, of)
        else:
            rows = rows.withColumnRenamed(own, made).drop(of)
        self.rows, self.made = rows, made

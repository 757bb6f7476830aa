"""Ordered and pivoting aggregations: wherever first or last matters, an order is given.

Defined cases: null keys are a key; nulls come first in an order; of rows equal in their order the value is
that of any of them; a text that is null is left out of joined texts, in which an empty one still has its separators;
repeated rows count as often as they occur; an empty table gives no rows; columns keep their names, and no others
are made on the way. Joined texts are one value a key, so a key's texts must fit one task: use
sequences.chunked first where a key may be long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_last(rows: DataFrame, keys: list[str], kind: str, kinds: list[str], value: str, order: list[str | Column], first: list[str] = ()) -> DataFrame:
    """For each key one column per kind with the last value by order, and the first value of other columns."""
    at = F.struct(*order)
    last = [F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, at)).alias(k) for k in kinds]
    return rows.groupBy(*keys).agg(*last, *[F.min_by(c, at).alias(c) for c in first])


def first_given(rows: DataFrame, keys: list[str], columns: list[str], order: list[str | Column]) -> DataFrame:
    """For each key the first value of each column that is neither null nor empty, each by itself."""
    at = F.struct(*order)
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(given(c), at)).alias(c) for c in columns])


def sums_by(rows: DataFrame, value: str, *columns: str) -> DataFrame:
    """Sums of value by each of the columns and over all rows in one pass; columns not summed by are null, and level tells which is."""
    sets = F.grouping_id()
    return rows.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(F.sum(value).alias(value), sets.alias("level"))


def _in_order(text: str, order: list[str], separator: str) -> Column:
    lines = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], F.col(text).alias("text"))))
    return F.array_join(F.transform(lines, lambda x: x["text"]), separator)


def rolled_text(rows: DataFrame, keys: list[str], text: str, order: list[str], separator: str = " ", **also: Column) -> DataFrame:
    """text: the texts of each key in order, joined; and other aggregates beside it."""
    return rows.groupBy(*keys).agg(_in_order(text, order, separator).alias(text), *[x.alias(n) for n, x in also.items()])


def roll_up_chunks(rows: DataFrame, keys: list[str], text: str, seconds: str, order: list[str]) -> DataFrame:
    """Of each chunk: its texts joined by '. ', and its first and last seconds."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(_in_order(text, order, ". ").alias("summary"), F.min_by(seconds, at).alias("start_time"), F.max_by(seconds, at).alias("end_time"))


def earliest(events: DataFrame, by: list[str], k: int = 40) -> DataFrame:
    return events.orderBy(*by).limit(k)


def prompt(blogs: Column, lines: Column, head: str, ask: str) -> Column:
    """One text of blog contents and 'time - text' lines."""
    blog = F.array_join(F.transform(blogs, lambda b: F.concat(b, F.lit("\n\n"))), "")
    said = F.array_join(F.transform(lines, lambda x: F.concat(x["timestamp"], F.lit(" - "), x["text"], F.lit("\n"))), "")
    return F.concat(F.lit(head + "\n\nBlog Contents:\n"), blog, F.lit("Transcript:\n"), said, F.lit("\n" + ask))

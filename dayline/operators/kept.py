"""First and last values kept up to date: partial aggregates are stored with their orders, and a batch touches only the parts that it has rows for.

A value by first or last is kept beside its place in the order, so it can be merged with later batches in any
sequence: the smaller or larger place wins, whenever it comes. Parts (a day, say) are functions of the key.
Each batch has a number and writes the merged state of its parts below it, then a row for each part to
the commits; the state of a part is that of the last batch committed with it. A batch that died is run
again under its number and replaces what it left; nothing reads a batch before its commit.

Defined cases: of equal places the smaller (first) or larger (last) value counts; rows that come again change nothing;
a null part or key is a part or key of its own; folder is no name for keys or values; a condition that is null is false; a null value under a
condition that holds is a value; a batch without rows commits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists


class Kept:
    """values: name -> ("first" or "last", value, condition or None), each by the columns of order."""

    def __init__(self, spark: SparkSession, path: str, *, keys: list[str], part: str, order: list[str], values: dict[str, tuple[str, Column, Column | None]]):
        self.spark, self.path, self.keys, self.part, self.order, self.values = spark, path, keys, part, order, values

    def _partial(self, rows: DataFrame) -> DataFrame:
        at = F.struct(*self.order)
        out = []
        for name, (which, value, given) in self.values.items():
            x = F.struct(at.alias("at"), value.alias("v"))
            x = x if given is None else F.when(given, x)
            out.append((F.min if which == "first" else F.max)(x).alias(name))
        return rows.groupBy(self.part, *[k for k in self.keys if k != self.part]).agg(*out)

    def _merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(self.part, *[k for k in self.keys if k != self.part]).agg(*[(F.min if which == "first" else F.max)(n).alias(n) for n, (which, _, _) in self.values.items()])

    def commits(self, but: int | None = None) -> DataFrame:
        """Each part (as text) with the last batch that holds it, a batch that is run again left out; a row for each part, whatever the batches."""
        if not exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], "part string, batch long")
        told = self.spark.read.schema("part string, batch long").parquet(f"{self.path}/commits")
        told = told if but is None else told.where(F.col("batch") != but)
        return told.groupBy("part").agg(F.max("batch").alias("batch"))

    def _folder(self, batch: int, part: str | None) -> str:
        return f"{self.path}/state/{batch}/folder={'null' if part is None else part.encode().hex()}"

    def _read(self, held: list, schema) -> DataFrame:
        """The state of parts, from their own folders alone."""
        folders = [self._folder(r["batch"], r["part"]) for r in held]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, batch: int) -> DataFrame:
        """Adds a batch's rows; the state of the parts that it touched. Parts are listed on the driver: as many as the batch touches."""
        new = self._partial(rows)
        text = F.col(self.part).cast("string")
        parts = [r[0] for r in rows.select(text).distinct().collect()]
        known = self.spark.createDataFrame([(p,) for p in parts], "part string")
        commits = self.commits(but=batch)
        held = known.join(commits, known["part"].eqNullSafe(commits["part"])).select(known["part"], "batch").collect()
        if parts:
            merged = self._merged(self._read(held, new.schema).unionByName(new))
            merged = merged.withColumn("folder", F.coalesce(F.lower(F.hex(text)), F.lit("null")))
            merged.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/state/{batch}")
            known.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return self._given(self._read([{"batch": batch, "part": p} for p in parts], new.schema))

    def _given(self, state: DataFrame) -> DataFrame:
        return state.select(self.part, *[k for k in self.keys if k != self.part], *[F.col(n)["v"].alias(n) for n in self.values])

    def table(self, like: DataFrame) -> DataFrame:
        """The values of all parts, each read from its last batch; like has the columns of the rows."""
        return self._given(self._read(self.commits().collect(), self._partial(like.limit(0)).schema))

"""The sources of a day from their files, some of which are missing or damaged.

A source is a folder of files: of a day, a month, or of all days, as the last date in a file's path tells. A source that
is not there is empty. A JSON file that can't be read as an array empties all sources of the days that it is for, as
the page of such a day is empty; lines with a wrong number of fields go alone. What was left out stands in
one table, the quarantine, with its file and the reason.

Defined cases: an empty JSON file is damaged, a blank line is nothing; a file of a month or of all days that is damaged
empties the days of the month or all; a JSON array of other things than objects has null fields; text files can't be damaged as a whole;
files whose names begin with _ or a dot are hidden from Spark, so an archive that names them so must be copied under other names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipe
from .files import exists

QUARANTINE = "source string, file string, scope string, whole boolean, text string, reason string"
#: Characters of a damaged text that the quarantine shows.
SHOWN = 80


def scope_of(path: Column) -> Column:
    """yyyy-mm-dd, yyyy-mm or '' for a file's path, by its last date with - or / between the parts."""
    day = F.regexp_extract(path, r".*[^0-9]([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})(?![0-9])", 0)
    parts = lambda pattern, n: F.concat_ws("-", *[F.regexp_extract(path, pattern, i + 1) for i in range(n)])
    days, months = r".*(?<![0-9])([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})(?![0-9])", r".*(?<![0-9])([0-9]{4})[-/]([0-9]{2})(?![0-9])"
    return F.when(day != "", parts(days, 3)).when(path.rlike(months), parts(months, 2)).otherwise("")


@dataclass
class Loaded:
    """rows of each source with their scope, and what was left out."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame

    def emptied(self, dates: DataFrame) -> DataFrame:
        """The dates (column date, text) that a damaged file empties."""
        bad = self.quarantine.where("whole").select("scope").distinct()
        keys = dates.select("date", F.explode(F.array(F.col("date"), F.substring("date", 1, 7), F.lit(""))).alias("scope"))
        return keys.join(bad, "scope", "left_semi").select("date").distinct()

    def blanked(self, view: DataFrame) -> DataFrame:
        """A day view in which the emptied days have empty arrays and nulls."""
        gone = self.emptied(view.select("date")).withColumn("emptied", F.lit(True))
        view = view.join(gone, "date", "left")
        of = {f.name: F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(None).cast(f.dataType) for f in view.schema.fields}
        return view.select("date", *[F.when(F.col("emptied"), of[c]).otherwise(F.col(c)).alias(c) for c in view.columns if c not in ("date", "emptied")])


def _json(spark: SparkSession, path: str, schema: str, name: str) -> tuple[DataFrame, DataFrame]:
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    whole = whole.withColumns({"scope": scope_of(F.col("file")), "v": F.try_parse_json("value")}).withColumn("fine", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.lit(False)))
    rows = whole.where("fine").select("scope", F.explode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("x")).select("scope", "x.*")
    bad = whole.where("NOT fine").select(F.lit(name).alias("source"), "file", "scope", F.lit(True).alias("whole"), F.substring("value", 1, SHOWN).alias("text"), F.lit("not a JSON array").alias("reason"))
    return rows, bad


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def _lines(spark: SparkSession, path: str, names: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    good, bad = pipe.parse(lines.withColumn("scope", scope_of(F.col("file"))), names)
    return good.drop("file"), bad.select(F.lit(name).alias("source"), "file", "scope", F.lit(False).alias("whole"), F.substring("value", 1, SHOWN).alias("text"), F.lit(f"not {len(names)} fields").alias("reason"))


def load(spark: SparkSession, root: str, *, json: dict[str, str], lines: dict[str, list[str]]) -> Loaded:
    """The sources below root, one folder each: JSON arrays of objects with their schemas, and pipe-delimited lines with their fields."""
    tables, bad = {}, spark.createDataFrame([], QUARANTINE)
    for name, schema in json.items():
        if exists(spark, f"{root}/{name}"):
            tables[name], out = _json(spark, f"{root}/{name}", schema, name)
            bad = bad.unionByName(out)
        else:
            tables[name] = spark.createDataFrame([], f"scope string, {schema}")
    for name, names in lines.items():
        if exists(spark, f"{root}/{name}"):
            tables[name], out = _lines(spark, f"{root}/{name}", names, name)
            bad = bad.unionByName(out)
        else:
            tables[name] = spark.createDataFrame([], "scope string, " + ", ".join(f"{n} string" for n in names))
    return Loaded(tables, bad)

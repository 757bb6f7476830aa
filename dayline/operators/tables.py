"""Tables and fields of scraped pages: a table scan, the column layouts of crew and spacewalk tables, page fields and article text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import times
from .scans import unused

CELL = "struct<text: string, html: string, links: array<struct<name: string, flag: string>>, small: string, bgcolor: string, flagged: boolean>"


class _Tables(HTMLParser):
    """Rows and cells of every table of the wanted class; a link takes the flag image before it in its cell."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.rows, self.table, self.row, self.inside = wanted, [], -1, None, 0
        self.cell = self.link = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table" and (self.inside or self.wanted is None or self.wanted in (a.get("class") or "").split()):
            self.inside += 1
            if self.inside == 1:
                self.table, self.row_no = self.table + 1, -1
        elif not self.inside:
            return
        elif tag == "tr":
            self.row_no += 1
            self.row = []
            self.rows.append({"table_no": self.table, "row_no": self.row_no, "cells": self.row})
            self.bgcolor = a.get("bgcolor") or (a.get("style") or None)
        elif tag in ("td", "th") and self.row is not None:
            self.cell = {"text": "", "html": "", "links": [], "small": None, "bgcolor": self.bgcolor, "flagged": False}
            self.row.append(self.cell)
            self.flag, self.in_flag, self.in_small = None, 0, False
        elif self.cell is not None:
            self.cell["html"] += self.get_starttag_text()
            if tag == "span":
                self.in_flag += 1 if self.in_flag or "flagicon" in (a.get("class") or "") else 0
                self.cell["flagged"] |= self.in_flag > 0
            elif tag == "img" and self.in_flag:
                self.flag = a.get("alt") or a.get("src")
            elif tag == "small":
                self.in_small, self.cell["small"] = True, ""
            elif tag == "a" and not self.in_flag:
                self.link = {"name": "", "flag": self.flag}

    def handle_endtag(self, tag):
        if not self.inside:
            return
        if tag == "table":
            self.inside -= 1
            self.cell = self.row = None if not self.inside else self.row
        elif tag in ("td", "th"):
            self.cell = None
        elif self.cell is not None:
            self.cell["html"] += f"</{tag}>"
            if tag == "span" and self.in_flag:
                self.in_flag -= 1
            elif tag == "small":
                self.in_small = False
            elif tag == "a" and self.link is not None:
                if self.link["name"].strip():
                    self.cell["links"].append({"name": self.link["name"].strip(), "flag": self.link["flag"]})
                self.link = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data
            self.cell["html"] += data
            if self.in_small:
                self.cell["small"] += data
            if self.link is not None:
                self.link["name"] += data


#: Characters of pages whose rows or texts a task gives out at once.
GIVEN = 1 << 20


def page_rows(page: str | None, wanted: str | None = "wikitable") -> list[dict]:
    """Rows with cells of a page's tables of a class, numbered in page order."""
    p = _Tables(wanted)
    p.feed(page or "")
    for row in p.rows:
        for c in row["cells"]:
            c["text"] = c["text"].strip()
    return [r for r in p.rows if r["cells"]]


def scan_tables(pages: DataFrame, html: str = "html", *, drop_last: bool = False) -> DataFrame:
    """One row for each table row below the first of its table: page columns but html, table_no, row_no, cells.

    A task holds the rows of one page, and of others up to GIVEN characters, however many pages a batch of Spark's has.
    """
    rest = [c for c in pages.columns if c != html]
    schema = StructType([*pages.select(*rest).schema.fields, *StructType.fromDDL(f"table_no int, row_no int, cells array<{CELL}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f.type for f in to_arrow_schema(StructType(schema.fields[len(rest) :]))}

        def given() -> pa.RecordBatch:
            own = [held.column(n + 1).take(pa.array(of, pa.int64())) for n in range(len(rest))]
            return pa.RecordBatch.from_arrays([*own, *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]], names=[*rest, *kinds])

        for held in batches:
            rows, of, size = [], [], 0
            for n, page in enumerate(held.column(0)):
                text = page.as_py() or ""
                found = [r for r in page_rows(text) if r["row_no"] > 0]
                rows += found
                of += [n] * len(found)
                size += len(text)
                if size >= GIVEN:
                    yield given()
                    rows, of, size = [], [], 0
            yield given()

    rows = pages.select(F.col(html).cast("string"), *rest).mapInArrow(run, schema)
    if drop_last:
        last = F.max("table_no").over(Window.partitionBy(*rest))
        (end,) = unused(rows, "end")
        rows = rows.withColumn(end, last).where(F.col("table_no") < F.col(end)).drop(end)
    return rows


#: Fields of a crew row.
FIELDS = ["expedition", "patch", "crew", "arrival", "arrival_flight", "departure", "departure_flight", "duration"]
# For rows that begin with a number, and those that begin with a flag, the layouts in the order they are tried: number of cells, cells that must say "transferred", and the cell of each field.
NUMBERED = [
    (2, (), (0, 1, 1, None, None, None, None, None)),
    (None, (3, 4), (0, 1, 2, None, None, None, None, None)),
    (None, (3,), (0, 1, 2, None, None, 4, 5, 6)),
    (None, (5,), (0, 1, 2, 3, 4, None, None, None)),
    (None, (), (0, 1, 2, 3, 4, 5, 6, 7)),
]
FLAGGED = [
    (2, (), (None, None, 0, None, None, None, None, None)),
    (3, (), (None, None, 0, 1, 2, None, None, None)),
    (None, (1,), (None, None, 0, None, None, 2, 3, 4)),
    (None, (3,), (None, None, 0, 1, 2, None, None, None)),
    (4, (), (None, None, 0, None, None, 1, 2, 3)),
    (None, (), (None, None, 0, 1, 2, 3, 4, 5)),
]


def layout(cells: Column) -> Column:
    """struct of the cell number of each field; null for a row of neither kind."""
    numbers = lambda places: F.struct(*[F.lit(p).cast("int").alias(n) for n, p in zip(FIELDS, places, strict=True)])

    def moved(i: int) -> Column:
        return F.coalesce(F.contains(F.lower(F.get(cells, F.lit(i))["text"]), F.lit("transferred")), F.lit(False))

    def choose(kinds: list) -> Column:
        out = None
        for size, where, places in reversed(kinds):
            test = F.lit(True) if size is None else F.size(cells) == size
            for i in where:
                test = test & moved(i)
            out = F.when(test, numbers(places)) if out is None else F.when(test, numbers(places)).otherwise(out)
        return out

    first = F.get(cells, F.lit(0))
    return F.when(T.is_number(F.trim(first["text"])), choose(NUMBERED)).when(first["flagged"], choose(FLAGGED))


def crew_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table rows (cells) as stays (expedition, patch, crew array, dates, flights, duration), and the rows that fit no layout."""
    rows = rows.withColumn("_at", layout(F.col("cells")))
    cell = lambda n: F.get("cells", F.col(f"_at.{n}"))
    clean = lambda c: F.trim(T.without_notes(c))
    date = lambda n: F.when(~F.contains(F.lower(cell(n)["text"]), F.lit("planned")), times.iso_z(times.day_month_year(clean(cell(n)["text"]))))
    crew = F.transform(cell("crew")["links"], lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["flag"], F.lit("Unknown")).alias("nationality")))
    rest = [c for c in rows.columns if c not in ("cells", "_at")]
    good = rows.where("_at IS NOT NULL").select(
        *rest, clean(cell("expedition")["text"]).alias("expedition"), T.absolute_url(F.nullif(F.regexp_extract(cell("patch")["html"], r'src="([^"]+)"', 1), F.lit(""))).alias("missionPatchUrl"), crew.alias("crew"),
        date("arrival").alias("arrivalDate"), clean(cell("arrival_flight")["text"]).alias("arrivalFlight"), date("departure").alias("departureDate"), clean(cell("departure_flight")["text"]).alias("departureFlight"), clean(cell("duration")["text"]).alias("durationDays"),
    )
    return good, rows.where("_at IS NULL").drop("_at")


def crew_stays(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each name: the nationality of its first row, and the first given value of every other field."""
    from .aggregates import first_given

    each = rows.select(*order, F.posexplode("crew").alias("n", "c"), "arrivalDate", "arrivalFlight", "departureDate", "departureFlight", "durationDays").select("*", "c.name", "c.nationality")
    return first_given(each, ["name"], ["nationality", "arrivalDate", "arrivalFlight", "departureDate", "departureFlight", "durationDays"], [*order, "n"])


def spacewalks(rows: DataFrame, keys: list[str], divider: str = "#CCCCCC") -> DataFrame:
    """Spacewalk records of table rows: 6 or 7 cells (the latter with a ground crew), each completed by the one-cell description row that comes next.

    Planned ones (TBD or TBC anywhere) and those without a start or before 2015 are left out.
    """
    from .sequences import pair_rows

    n, at = F.size("cells"), lambda i: F.get("cells", F.lit(i))
    rows = rows.where(~F.coalesce(F.contains(F.upper(at(0)["bgcolor"]), F.lit(divider)), F.lit(False)))
    after = F.when(n == 7, 4).otherwise(3)
    names = lambda c: F.transform(F.filter(c["links"], lambda x: F.trim(x["name"]) != ""), lambda x, i: F.struct((i + 1).alias("ev"), x["name"].alias("name"), x["flag"].alias("nationality")))
    field = lambda i: F.trim(F.get("cells", after + i)["text"])
    record = rows.select(
        *keys, "row_no", n.alias("n"), F.replace(F.trim(at(0)["text"]), F.lit("."), F.lit("")).alias("number"), F.trim(at(1)["text"]).alias("mission"), F.regexp_extract(at(1)["small"], r"(\d+)", 1).try_cast("int").alias("missionEvaNum"),
        names(at(2)).alias("crew"), F.when(n == 7, names(at(3))).alias("groundIVcrew"), field(0).alias("start"), field(1).alias("end"), field(2).alias("duration"), at(0)["html"].alias("html"),
    )
    carry = ["number", "mission", "missionEvaNum", "crew", "groundIVcrew", "start", "end", "duration"]
    found = pair_rows(record, keys, ["row_no"], F.col("n").isin(6, 7), F.col("n") == 1, carry)
    found = found.select(*keys, *[F.col(f"open_{c}").alias(c) for c in carry], T.description_html(F.col("html")).alias("description"))
    open_ended = lambda c: F.col(c).isin("TBD", "TBC")
    done = found.where(F.forall("crew", lambda c: ~c["name"].isin("TBD", "TBC")) & ~open_ended("start") & ~open_ended("end") & ~open_ended("duration"))
    done = done.withColumn("startTime", times.day_month_year(F.col("start"))).withColumn("endTime", times.day_month_year(F.col("end")))
    return done.where(times.since(F.col("startTime"), "2015-01-01")).drop("start", "end")


def labelled_field(html: Column, *labels: str) -> Column:
    """The text of the cell after a header cell that says one of the labels."""
    said = "|".join(labels)
    cell = F.regexp_extract(html, rf"(?is)<th[^>]*>\s*(?:<[^>]+>\s*)*(?:{said})\b[^<]*(?:</[^>]+>\s*)*</th>\s*<td[^>]*>(.*?)</td>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]+>", ""), r"&#160;|&nbsp;", " ")), F.lit(""))


def expedition_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """start and end of an expedition page as dates where they can be read."""
    page = F.col(html)
    return pages.select(*[c for c in pages.columns if c != html], times.month_name_date(labelled_field(page, "start", "launch")).alias("start"), times.month_name_date(labelled_field(page, "end", "landing")).alias("end"))


class _Article(HTMLParser):
    """Texts of paragraphs, second and third headings and list items of the first article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.parts, self.open = 0, False, [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "article" and not self.done:
            self.depth += 1
        elif self.depth and tag in ("p", "h2", "h3", "li"):
            self.parts.append("")
            self.open = 1

    def handle_endtag(self, tag):
        if tag == "article" and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth
        elif tag in ("p", "h2", "h3", "li"):
            self.open = 0

    def handle_data(self, data):
        if self.depth and self.open and not self.done:
            self.parts[-1] += data


def article_text(html: Column) -> Column:
    """Lines of the first article; '' without one."""

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            done, out, size = [pa.array([], pa.string())], [], 0
            for page in pages:
                text = page.as_py() or ""
                p = _Article()
                p.feed(text)
                out.append("\n".join(x.strip() for x in p.parts if x.strip()))
                size += len(text)
                if size >= GIVEN:
                    done.append(pa.array(out, pa.string()))
                    out, size = [], 0
            yield pa.concat_arrays([*done, pa.array(out, pa.string())])

    return read(html)

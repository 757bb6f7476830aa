"""A sink of one JSON document for each row, below folders of days, under names that are free: a Python data source with task and job commits.

A task writes its documents to a folder of its own beside the target and moves them to their places when all
are written; what it moves, it lists before in a file for the job. If the task fails, it takes back what it moved; if the
job fails, it takes back what its tasks have listed, also those that still run or were killed, and these find the job
closed before they move more. So a failed job leaves nothing, and one that is run again by Spark writes the same
documents to the same names.

Defined cases: null fields stay in a document as null; a row with a null time is under day 0000/00/00; a row with a
null name is an error, since it has no place; names that are taken, by the target's documents or by other
rows, get the first free number (sequences.collision_names); no rows write nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..operators import sequences
from .files import exists, few_tasks

FIELDS = "folder string, name string, value string"


def open_place(path: str):
    """The file system of a path or URI that Spark names, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Moved(WriterCommitMessage):
    """Of a finished task: the file that lists what it moved, and how many."""

    listing: str
    n: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex
        system, base = open_place(self.path)
        system.create_dir(f"{base}/_temporary/{self.job}", recursive=True)
        system.open_output_stream(f"{base}/_temporary/{self.job}/open").close()

    def _check_open(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/_temporary/{self.job}/open").type == fs.FileType.NotFound:
            raise RuntimeError("the job was aborted")

    def _delete(self, system, places: list[str]) -> None:
        for place in places:
            try:
                system.delete_file(place)
            except FileNotFoundError:
                pass

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, base = open_place(self.path)
        own = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}"
        self._check_open(system, base)
        system.create_dir(own, recursive=True)
        places, folders, moved = [], set(), []
        try:
            for n, row in enumerate(rows):
                if row["name"] is None:
                    raise ValueError("a document without a name has no place")
                with system.open_output_stream(f"{own}/{n}") as out:
                    out.write((row["value"] or "{}").encode())
                places.append(f"{base}/{row['folder']}/{row['name']}")
                folders.add(f"{base}/{row['folder']}")
            with system.open_output_stream(f"{own}/listing") as out:
                out.write(json.dumps(places).encode())
            self._check_open(system, base)  # abort() closes the job first and then reads the listings
            for folder in folders:
                system.create_dir(folder, recursive=True)
            for n, place in enumerate(places):
                system.move(f"{own}/{n}", place)
                moved.append(place)
        except BaseException:
            self._delete(system, moved)
            self._delete_dir(system, own)
            raise
        return Moved(f"{own}/listing", len(places))

    def _delete_dir(self, system, folder: str) -> None:
        """Deletes a folder in which a task may still write, or that is gone."""
        for left in reversed(range(5)):
            try:
                return system.delete_dir(folder)
            except FileNotFoundError:
                return None
            except OSError:
                if not left:
                    raise

    def _clear(self, system, base: str) -> None:
        self._delete_dir(system, f"{base}/_temporary/{self.job}")
        if not system.get_file_info(_all(f"{base}/_temporary")):
            self._delete_dir(system, f"{base}/_temporary")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*open_place(self.path))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Closes the job, so that no task moves what it hasn't listed; takes the places of tasks' sources and then what they moved."""
        system, base = open_place(self.path)
        self._delete(system, [f"{base}/_temporary/{self.job}/open"])
        places = []
        for task in system.get_file_info(_all(f"{base}/_temporary/{self.job}")):
            try:
                with system.open_input_stream(f"{task.path}/listing") as f:
                    places += json.loads(f.read())
            except (FileNotFoundError, ValueError):
                pass  # not yet listed in full, so nothing was moved
        self._clear(system, base)
        self._delete(system, places)


def _all(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class DocumentSource(DataSource):
    """Rows (folder, name, value) to one file each."""

    @classmethod
    def name(cls) -> str:
        return "day_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents are only added")
        return DocumentWriter(self.options["path"])


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """folder and name of the documents below a path; their contents are not read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "folder string, name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path")
    place = r"/([0-9]{4}/[0-9]{2}/[0-9]{2})/([^/]+)$"
    return few_tasks(files).where(F.col("path").rlike(place)).select(F.regexp_extract("path", place, 1).alias("folder"), F.regexp_extract("path", place, 2).alias("name"))


def write_documents(rows: DataFrame, path: str, *, name: str, at: str, order: list[str]) -> None:
    """Adds one JSON document for each row, all its columns but at, below the day of at (UTC), under its name or the next free one; order tells who asks first."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    day = F.coalesce(F.date_format(at, "yyyy/MM/dd"), F.lit("0000/00/00"))
    value = F.to_json(F.struct(*[c for c in rows.columns if c != at]), {"ignoreNullFields": "false"})
    by = {f"order{n}": F.col(c) for n, c in enumerate(order)}
    flat = rows.select(value.alias("value"), day.alias("folder"), F.concat(day, F.lit("/"), F.col(name)).alias("place"), *[c.alias(n) for n, c in by.items()])
    taken = documents_in(spark, path).select(F.concat("folder", F.lit("/"), "name").alias("name"))
    found = sequences.collision_names(flat, "place", list(by), "place", taken)
    found.select("folder", F.regexp_extract("place", r"([^/]+)$", 1).alias("name"), "value").write.format("day_documents").mode("append").option("path", path).save()

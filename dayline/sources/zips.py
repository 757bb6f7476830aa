"""Members of zip archives by ranged reads: an index of all archives' directories, then each member by itself.

The directory at an archive's end tells where its members lie. It is read alone, and the members, however
many an archive has, are dealt evenly to tasks, each of which opens the archive at the member's place. So no
task holds an archive, and one large archive is read by all.

Defined cases: a file that is no archive, or whose directory is damaged, has one row with null name and the reason in
error; a member that can't be read, or whose checksum fails, has null content and the reason in error;
folders in an archive are no members; members of equal names are apart by offset; an archive without members has no rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import open_place

INDEX = "path string, name string, offset long, packed long, size long, method int, crc long, error string"
#: Bytes of contents that a task gives out at once.
GIVEN = 16 << 20


def _directory(path: str) -> list[tuple]:
    system, place = open_place(path)
    try:
        with system.open_input_file(place) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 16)) as z:
            return [(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, None) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:
        return [(path, None, None, None, None, None, None, str(e)[:200])]


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The members of a folder's archives (.zip in any case), from their directories alone."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def scan(frames):
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame(_directory(path), columns=names).astype({c: "Int64" for c in ("offset", "packed", "size", "method", "crc")})

    archives = spark.read.format("binaryFile").load(folder).select("path").where(F.endswith(F.lower("path"), F.lit(".zip")))
    return archives.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(scan, INDEX)


def _member(f, offset: int, packed: int, method: int, crc: int) -> tuple[bytes | None, str | None]:
    try:
        f.seek(offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            return None, "no member begins there"
        f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        data = f.read(packed)
        if len(data) < packed:
            return None, "cut off"
        if method == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        elif method != zipfile.ZIP_STORED:
            return None, f"compressed by method {method}"
        return (data, None) if zlib.crc32(data) == crc else (None, "checksum differs")
    except (OSError, ValueError, zlib.error, struct.error) as e:
        return None, str(e)[:200]


def contents(found: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of an index with their content, dealt evenly to so many tasks (as many as the session shuffles to)."""
    names = found.columns

    def run(batches):
        path, f, out, size = None, None, [], 0

        def given():
            columns = [pa.array([r[names.index(c)] for r in out], held.schema.field(c).type) for c in names if c != "error"]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[-2] for r in out], pa.string()), pa.array([r[-1] for r in out], pa.binary())], names=[*[c for c in names if c != "error"], "error", "content"])

        for held in batches:
            for row in held.to_pylist():
                data, error = None, row["error"]
                if row["name"] is not None:
                    if row["path"] != path:
                        if f is not None:
                            f.close()
                        system, place = open_place(row["path"])
                        path, f = row["path"], system.open_input_file(place)
                    data, error = _member(f, row["offset"], row["packed"], row["method"], row["crc"])
                out.append((*[row[c] for c in names], error, data))
                size += len(data or b"")
                if size >= GIVEN:
                    yield given()
                    out, size = [], 0
            if out:
                yield given()
                out, size = [], 0
        if f is not None:
            f.close()

    parts = parts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, F.xxhash64("path", "offset")).sortWithinPartitions("path", "offset")
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c != "error") + ", error string, content binary"
    return dealt.mapInArrow(run, schema)


def dealt(rows: DataFrame, name: str, content: str, *, least: int = 2, archive_bytes: int = 64 << 20) -> DataFrame:
    """rows in partitions for archives of some archive_bytes of content each, so that their number, and no archive, grows with the rows."""
    n_bytes = rows.agg(F.sum(F.octet_length(content).cast("long"))).first()[0] or 0
    return rows.repartition(max(least, -(-n_bytes // archive_bytes)), name)


def write_archives(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One archive for each partition of rows, its members in the order of the partition, written as they stream past: path and n_members. A task that is run again writes its archive anew."""

    def run(frames):
        place = f"{folder}/part-{TaskContext.get().partitionId():05d}.zip"
        system, path = open_place(place)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(path) as out, zipfile.ZipFile(io.BufferedWriter(out), "w", zipfile.ZIP_DEFLATED) as z:
            for frame in frames:
                for a, b in zip(frame["name"], frame["content"], strict=True):
                    z.writestr(a, b or b"")
                    n += 1
        yield pd.DataFrame({"path": [place], "n_members": [n]})

    return rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "path string, n_members long")

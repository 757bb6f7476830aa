"""Exact duplicates by Grace hash partitioning: records are dealt to buckets on disk, again and again, until a bucket's distinct contents fit an open-addressing table that compares them byte by byte.

1. Each task meets its own rows in such a table first, so of any number of copies it sends one record with
   their number and their best row; the other copies wait in a written table for their record's answer.
2. Records are dealt to buckets by a hash of their content; the shuffle's files are the first level's
   spill files. A bucket whose contents outgrow the table gives its records back unresolved.
3. These are written to the shared folder and dealt by a hash of another seed to buckets of their own,
   level after level. Equal contents always meet, and a single content always fits.

A bucket holds bucket_bytes of contents beside its longest one, and 24 bytes for each task that met one of
them, so the number of copies of a text sets neither memory nor what is shuffled.

Defined cases: texts are equal when they are without the characters of WHITE; a null text is empty, and empty
texts are equal; the row with the most code points stays, then the one with the smallest doc_id, a null one
last; of repeated rows one stays; an empty table gives no rows; other columns are not used, and keep_one()
returns them as they are.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, parts_for, stored, unused

#: Bytes of the distinct contents that a task's table holds, beside its longest one.
BUCKET_BYTES = 32 << 20
#: What an entry of a table takes besides its content.
ENTRY_BYTES = 200
#: Characters that texts are compared without.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of contents given out at once.
GIVEN_BYTES = 8 << 20

_LONG = pa.int64()
#: rep is the row that a record was made for; n, chars, keep_id and keep_row tell of all rows that it stands for.
RECORD = {"content": pa.binary(), "size": _LONG, "n": _LONG, "chars": _LONG, "keep_id": _LONG, "keep_row": _LONG, "rep": _LONG, "rep_id": _LONG}
RECORD_DDL = "content binary, size long, n long, chars long, keep_id long, keep_row long, rep long, rep_id long"


class Contents:
    """Distinct contents by open addressing with linear probing."""

    def __init__(self):
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []
        self.n_bytes = self.longest = 0

    def place(self, content: bytes) -> int:
        """The number of a content, a new one if no content of the table is equal in every byte."""
        h = xxhash.xxh3_64_intdigest(content)
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.n_bytes += len(content) + ENTRY_BYTES
        self.longest = max(self.longest, len(content) + ENTRY_BYTES)
        if 2 * len(self.contents) > len(slots):
            self._widen()
        return len(self.contents) - 1

    def _widen(self) -> None:
        self.slots = slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry

    def beyond(self, most: int) -> bool:
        """Whether the contents take more than most bytes beside the longest."""
        return self.n_bytes - self.longest > most


class Groups(Contents):
    """Contents with the rows that they stand for: how many, and the best of them."""

    def __init__(self):
        super().__init__()
        self.n, self.best = [], []

    def add(self, content: bytes, n: int, best: tuple) -> int:
        """best: minus the code points, whether the id is null, the id (0 if null), the row; the smallest is the best."""
        entry = self.place(content)
        if entry == len(self.n):
            self.n.append(n)
            self.best.append(best)
        else:
            self.n[entry] += n
            if best < self.best[entry]:
                self.best[entry] = best
        return entry


def _best(chars: int, doc_id: int | None, row: int) -> tuple:
    return -chars, doc_id is None, doc_id or 0, row


def _id(best: tuple) -> int | None:
    return None if best[1] else best[2]


def _collapse(most: int):
    """Rows (row, doc_id, chars, text) to records, and to rows (rep, row and doc_id, without n) of the copies that a task met again."""
    names = ["row", "doc_id", *RECORD]
    kinds = [_LONG, _LONG, *RECORD.values()]

    def records(groups: Groups, reps: list[tuple[int, int | None]]):
        at = 0
        while at < len(reps):
            upto, held = at, 0
            while upto < len(reps) and held < GIVEN_BYTES:
                held += len(groups.contents[upto])
                upto += 1
            s, best = slice(at, upto), groups.best[at:upto]
            contents = groups.contents[s]
            columns = [[None] * len(contents)] * 2 + [contents, [len(c) + ENTRY_BYTES for c in contents], groups.n[s], [-b[0] for b in best], [_id(b) for b in best], [b[3] for b in best], [r for r, _ in reps[s]], [d for _, d in reps[s]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            at = upto

    def run(batches):
        groups, reps = Groups(), []
        for batch in batches:
            again: list[tuple] = []
            for row, doc_id, chars, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["chars"].to_pylist(), batch["text"], strict=True):
                content = (text.as_py() or b"").translate(None, WHITE)
                entry = groups.add(content, 1, _best(chars, doc_id, row))
                if entry == len(reps):
                    reps.append((row, doc_id))
                else:
                    again.append((row, doc_id, reps[entry][0]))
                if groups.beyond(most):
                    yield from records(groups, reps)
                    groups, reps = Groups(), []
            if again:
                rows, ids, of = (pa.array(x, _LONG) for x in zip(*again, strict=True))
                blank = {"rep": of}
                yield pa.RecordBatch.from_arrays([rows, ids, *[blank.get(c, pa.nulls(len(again), k)) for c, k in RECORD.items()]], names=names)
        yield from records(groups, reps)

    return run


ANSWER = {"rep": _LONG, "rep_id": _LONG, "keep_id": _LONG, "keep_row": _LONG, "group_size": _LONG, "sha": pa.binary()}
BUCKET = {"group_size": _LONG, "sha": pa.binary()} | RECORD
BUCKET_DDL = "group_size long, sha binary, " + RECORD_DDL


def _resolve(most: int):
    """A bucket's records to an answer for each; or, if its contents don't fit, to the records themselves (without group_size)."""

    def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in BUCKET.items()], names=list(BUCKET))

    def back(groups: Groups, entries: array, rows: array, ids: list):
        """The records so far: what an entry stands for goes with its first."""
        first = set()
        for at in range(0, len(entries), 256):
            out = []
            for entry, rep, rep_id in zip(entries[at : at + 256], rows[at : at + 256], ids[at : at + 256], strict=True):
                best, n = groups.best[entry], 0 if entry in first else groups.n[entry]
                first.add(entry)
                content = groups.contents[entry]
                out.append((content, len(content) + ENTRY_BYTES, n, -best[0], _id(best), best[3], rep, rep_id))
            yield batch_of({c: pa.array(x, k) for (c, k), x in zip(RECORD.items(), zip(*out, strict=True), strict=True)})

    def run(batches):
        groups, entries, rows, ids, full = Groups(), array("q"), array("q"), [], False
        for batch in batches:
            if not full:
                told = [batch[c].to_pylist() for c in ("n", "chars", "keep_id", "keep_row", "rep", "rep_id")]
                for content, n, chars, keep_id, keep_row, rep, rep_id in zip(batch["content"], *told, strict=True):
                    entries.append(groups.add(content.as_py(), n, _best(chars, keep_id, keep_row)))
                    rows.append(rep)
                    ids.append(rep_id)
                if full := groups.beyond(most):
                    yield from back(groups, entries, rows, ids)
                    groups = entries = rows = ids = None
            else:
                yield batch_of({c: batch[c] for c in RECORD})
        if not full and len(entries):
            of = pa.array(np.frombuffer(entries, dtype=np.int64))
            sha = pa.array([hashlib.sha256(c).digest() for c in groups.contents], pa.binary())
            told = {"group_size": pa.array(groups.n, _LONG), "sha": sha, "keep_id": pa.array([_id(b) for b in groups.best], _LONG), "keep_row": pa.array([b[3] for b in groups.best], _LONG)}
            reps, rep_ids = pa.array(np.frombuffer(rows, dtype=np.int64)), pa.array(ids, _LONG)
            for at in range(0, len(of), 50_000):
                part = of.slice(at, 50_000)
                yield batch_of({c: x.take(part) for c, x in told.items()} | {"rep": reps.slice(at, 50_000), "rep_id": rep_ids.slice(at, 50_000)})

    return run


def _groups(rows: DataFrame, bucket_bytes: int) -> DataFrame:
    """row, doc_id, keep_id, keep_row, group_size and sha of rows (row, doc_id, text)."""
    told = rows.select("row", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"), F.col("text").cast("binary").alias("text"))
    met = stored(told.mapInArrow(_collapse(bucket_bytes), "row long, doc_id long, " + RECORD_DDL), "records")
    records, level, answers = met.where("n IS NOT NULL").select(*RECORD), 0, []
    size = records.agg(F.sum("size")).first()[0] or 0
    while size:
        # half the bound is expected, so the first level rarely leaves anything, and a later one half as much again
        dealt = records.repartition(parts_for(2 * size, bucket_bytes) << level, F.xxhash64(F.lit(level), "content"))
        out = stored(dealt.mapInArrow(_resolve(bucket_bytes), BUCKET_DDL), f"buckets-{level}")
        answers.append(out.where("group_size IS NOT NULL").select(*ANSWER))
        records, level = out.where("group_size IS NULL").select(*RECORD), level + 1
        size = records.agg(F.sum("size")).first()[0] or 0
    if not answers:
        drop_stored(met)
        return rows.sparkSession.createDataFrame([], "row long, doc_id long, keep_id long, keep_row long, group_size long, sha binary")
    every = answers[0]
    for x in answers[1:]:
        every = every.unionByName(x)
    own = every.select(F.col("rep").alias("row"), F.col("rep_id").alias("doc_id"), "keep_id", "keep_row", "group_size", "sha")
    again = met.where("n IS NULL").select("row", "doc_id", "rep").join(every.drop("rep_id"), "rep")
    return own.unionByName(again.drop("rep"))


def mark(documents: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For each row of documents: doc_id, keep_id (of the row of its group that stays), group_size, kept and text_sha256 (lowercase hex, of the text without WHITE)."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _groups(rows, bucket_bytes)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(documents: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of documents that stay, with all their columns."""
    row = unused("row", *documents.columns)
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _groups(numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), bucket_bytes)
    stays = found.where("row = keep_row").select(F.col("row").alias(row))
    return numbered.join(stays, row, "left_semi").drop(row)

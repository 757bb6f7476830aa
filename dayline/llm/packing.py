"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Each document's ids are cut at multiples of the sequence length. The pieces are dealt to groups by
a hash of their own values and of the partition they are read in; each group of bounded expected size
is packed by itself, so no step sees more than a group. Groups hold pieces, not documents, so a very
long document spreads out, and repeated rows of different partitions go to different groups.

Defined cases: a null or empty text is one piece holding the end id alone; a null doc_id is kept
as null; repeated rows are packed as often as they occur; an empty table gives no rows; other
columns of the input are not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, release, text_bytes
from .tokens import encoder, few_at_once

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, grp long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class Bins:
    """A tournament tree over bins: each inner node holds the most room below it, so the first bin with room is found in log steps."""

    def __init__(self, most: int, size: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def place(self, n: int) -> tuple[int, int]:
        """The first bin with room for n, and the room it had."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < n:
                i += 1
        had = room[i]
        room[i] = had - n
        bin_no = i - self.leaves
        while i > 1:
            i //= 2
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
        return bin_no, had


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, which come in falling order and are at most size."""
    bins, out = Bins(len(lengths), size), ([], [])
    for n in lengths:
        b, had = bins.place(n)
        out[0].append(b)
        out[1].append(size - had)
    return out


def _pack_group(size: int):
    def pack(table: pa.Table) -> pa.Table:
        release()
        frame = table.select(["doc_id", "start", "length"]).to_pandas()
        frame["crc"] = [zlib.crc32(x.as_buffer()) for x in table["ids"]]
        order = frame.sort_values(["length", "doc_id", "start", "crc"], ascending=[False, True, True, True], kind="stable").index.to_numpy()
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy()[order].tolist(), size)
        table = table.take(pa.array(order))
        sequence = (table["grp"].to_numpy() << 32) + np.asarray(bins, dtype=np.int64)
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def pieces(documents: DataFrame, vocab: str, *, kind: str = "word", end_id: int = 1, size: int = 2048, n_groups: int = 1) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of size, with the group that packs the piece."""

    def run(batches):
        encode, origin = encoder(vocab, kind), TaskContext.get().partitionId()
        for batch in batches:
            for docs, texts in few_at_once(batch):
                every, ends = encode.with_end(texts, end_id)
                rows = []
                for doc, a, b in zip(docs.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    for at in range(a, b, size):
                        part = every[at : min(b, at + size)].tobytes()
                        rows.append((doc, at - a, len(part) // 4, b - a, part, zlib.crc32(f"{doc},{at - a},{zlib.crc32(part)},{origin}".encode()) % n_groups))
                yield _batch(rows)
        release()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "grp"])


def pack(documents: DataFrame, vocab: str, *, kind: str = "word", end_id: int = 1, size: int = 2048, group_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of documents with their ids (little-endian unsigned 32-bit) and their place: sequence_id and offset.

    group_bytes is the expected text of a group; it bounds what one task holds and grows with nothing.
    """
    cut = pieces(documents, vocab, kind=kind, end_id=end_id, size=size, n_groups=parts_for(text_bytes(documents), group_bytes))
    return cut.groupBy("grp").applyInArrow(_pack_group(size), PACKED)


def sequences(packed: DataFrame, *, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: token ids padded to size, unless the sequence's own length is a power of two."""

    def join(key, table):
        order = np.argsort(table["offset"].to_numpy(), kind="stable")
        ids = np.frombuffer(b"".join(table["ids"][int(i)].as_py() for i in order), dtype="<u4")
        padded = ids if len(ids) & (len(ids) - 1) == 0 else np.pad(ids, (0, size - len(ids)), constant_values=pad_id)
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([padded.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids array<long>")

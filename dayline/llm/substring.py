"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the corpus; repeated windows merge into maximal intervals.

Rows are dealt once to parts by a hash of their own values. Each part hashes all of its windows and
sends its distinct hashes, packed by hash range, to be counted; a hash that two parts send, or one
part holds twice, is repeated. The repeated hashes go back to the parts that sent them, which read
the same dealt rows again, merge the covered windows of each text and cut them out. A frequent
passage is sent once by each part, so no range grows with its copies.

The hash of a window is a polynomial over 64-bit XXH3 values of its words, modulo 2**64, and the
range comes from a second, independent polynomial, so two windows are taken for equal only if the
64 bits and the range both agree.

Defined cases: a null text has no words and keeps nothing; an empty text likewise; texts shorter
than the window lose nothing; repeated rows cover each other, and are dealt by the partition they come
from, so that no part holds them all; a null doc_id is kept; an empty table gives no rows; all columns
of the input are kept beside the result, those with a result's name as input_<name>.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part_of, parts_for, release, text_bytes, unused

#: Odd multipliers of the two polynomials (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words whose hashes a task remembers.
WORDS_KEPT = 150_000


class _Words(dict):
    """Row of each word in the tables of word hashes."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1 << 16, 2), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        d = xxhash.xxh3_128_intdigest(word)
        self.table[n] = (d & (2**64 - 1), d >> 64)
        self[word] = n
        return n


def _powers(n: int, r: int) -> np.ndarray:
    out = np.full(n + 1, r, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Window hashes of lists of words. Sums of falling powers over a window come from running sums, whose rising powers are divided out (the multiplier is odd, so it has an inverse)."""

    def __init__(self, window: int):
        self.window, self.words = window, _Words()
        self.scale = [pow(r, -1, 2**64) for r in MULTIPLIERS]
        self.up = [_powers(1 << 12, r) for r in MULTIPLIERS]
        self.down = [_powers(1 << 12, r) for r in self.scale]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        if n < self.window:
            none = np.empty(0, dtype=np.uint64)
            return none, none
        if len(self.words) > WORDS_KEPT:
            self.words = _Words()
        rows = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=n)
        out = []
        for k in range(2):
            if len(self.up[k]) <= n:
                self.up[k], self.down[k] = _powers(2 * n, MULTIPLIERS[k]), _powers(2 * n, self.scale[k])
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.words.table[rows, k] * self.up[k][:n], out=sums[1:])
            h = (sums[self.window :] - sums[: -self.window]) * self.down[k][: n - self.window + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            out.append(h ^ (h >> np.uint64(29)))
        return out[0], out[1]


def _words(text) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").split()


def _send(column: str, window: int, n_ranges: int):
    """A part's rows to its distinct window hashes: one row for each range, sorted, with a mark on those it holds twice."""

    def run(table: pa.Table) -> pa.Table:
        release()
        hasher, hashes, ranges = Hasher(window), [], []
        for text in table[column]:
            h, second = hasher(_words(text))
            hashes.append(h)
            ranges.append(((second >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32))
        h, at = np.concatenate(hashes), np.concatenate(ranges)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        starts = np.flatnonzero(first)
        twice = np.diff(np.append(starts, len(h))) > 1
        h, at = h[starts], at[starts]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(h)) if len(at) else cuts
        part = table["part"][0].as_py()
        return pa.table({"range": pa.array(at[cuts], pa.int32()), "part": pa.array([part] * len(cuts), pa.int32()), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one range, what each part sent: the hashes that occur again, for each part that sent them."""
    sent = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in table["hashes"]]
    twice = [np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8), count=len(h)).astype(bool) for b, h in zip(table["twice"], sent, strict=True)]
    every = np.sort(np.concatenate(sent + [h[t] for h, t in zip(sent, twice, strict=True)]))
    again = every[1:][every[1:] == every[:-1]]
    again = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
    parts, out = [], []
    for part, h in zip(table["part"].to_pylist(), sent, strict=True):
        found = h[np.isin(h, again, assume_unique=True)] if len(again) else again
        if len(found):
            parts.append(part)
            out.append(found.tobytes())
    number = table["range"][0].as_py()
    return pa.table({"part": pa.array(parts, pa.int32()), "range": pa.array([number] * len(parts), pa.int32()), "hashes": pa.array(out, pa.binary())})


def intervals(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words covered by the windows that start at hit, which rises."""
    if not len(hit):
        return []
    gap = np.flatnonzero(hit[1:] > hit[:-1] + window)
    return list(zip(hit[np.append(0, gap + 1)].tolist(), (hit[np.append(gap, len(hit) - 1)] + window).tolist(), strict=True))


def _cut(column: str, window: int, n_ranges: int, schema: pa.Schema):
    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        release()
        hasher, out = Hasher(window), {"n_words": [], "removed": [], "kept": []}
        sets = dict(zip(back["range"].to_pylist(), back["hashes"], strict=True))
        # within a part a hash is looked up together with its range
        keys = np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint64) for b in sets.values()]) if sets else np.empty(0, dtype=np.uint64)
        at = np.repeat(np.array(list(sets), dtype=np.int64), [len(b.as_py()) // 8 for b in sets.values()]) if sets else np.empty(0, dtype=np.int64)
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        for text in rows[column]:
            words = _words(text)
            h, second = hasher(words)
            spans: list[tuple[int, int]] = []
            if len(keys) and len(h):
                rng = ((second >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
                place = np.searchsorted(keys, h)
                hit = np.zeros(len(h), dtype=bool)
                live = np.flatnonzero(place < len(keys))
                while len(live):  # equal hashes of different ranges stand side by side
                    same = keys[place[live]] == h[live]
                    hit[live[same & (at[place[live]] == rng[live])]] = True
                    live = live[same & ~hit[live]]
                    place[live] += 1
                    live = live[place[live] < len(keys)]
                spans = intervals(np.flatnonzero(hit), window)
            kept, last = [], 0
            for a, b in spans:
                kept += words[last:a]
                last = b
            kept += words[last:]
            out["n_words"].append(len(words))
            out["removed"].append([{"start": a, "end": b} for a, b in spans])
            out["kept"].append(b" ".join(kept))
        rows = rows.drop_columns(["part"])
        kept = pa.array(out["kept"], pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([*rows.columns, pa.array(out["n_words"], pa.int64()), pa.array(out["removed"], schema.field("removed").type), kept], names=schema.names)

    return run


#: Columns of the result beside the input's.
RESULT = ("n_words", "removed", "kept")


def _dedup(documents: DataFrame, window: int, part_bytes: int, range_bytes: int) -> DataFrame:
    """The input's columns as c0, c1, ... and then those of RESULT."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n_bytes = text_bytes(documents)
    n_parts, n_ranges = parts_for(n_bytes, part_bytes), parts_for(n_bytes, range_bytes)
    # a partition's number spreads rows that are repeated
    part = part_of(n_parts, F.coalesce(F.xxhash64("doc_id", "text"), F.lit(0)), F.spark_partition_id())
    text = f"c{documents.columns.index('text')}"
    columns = [(F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(documents.columns)]
    documents = documents.select(*columns, part.alias("part"))
    docs = documents.repartition("part")
    # all columns, so that both readings of the parts share one exchange
    sent = docs.groupBy("part").applyInArrow(_send(text, window, n_ranges), "range int, part int, hashes binary, twice binary")
    back = sent.groupBy("range").applyInArrow(_count, "part int, range int, hashes binary")
    result = StructType.fromDDL("n_words long, removed array<struct<start: long, end: long>>, kept string")
    schema = StructType([*documents.drop("part").schema.fields, *result.fields])
    cut = _cut(text, window, n_ranges, to_arrow_schema(schema))
    return docs.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(cut, schema)


def dedup(documents: DataFrame, *, window: int = 35, part_bytes: int = 3 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """The documents with n_words long, removed array<struct<start,end>> (word intervals, end excluded) and kept string (words left, joined by one space).

    part_bytes is the expected text of a part, range_bytes about the hashes counted at once; both
    bound what a task holds, and their numbers grow with the input.
    """
    cut, names = _dedup(documents, window, part_bytes, range_bytes), []
    for c in documents.columns:
        names.append(unused(f"input_{c}", *documents.columns, *names) if c.lower() in RESULT else c)
    return cut.toDF(*names, *RESULT)


def without_repeats(documents: DataFrame, *, window: int = 35, part_bytes: int = 3 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """The documents with their own columns, repeated passages cut from text (and n_chars, if there is one, counted anew); a document whose every word goes is dropped, texts that lose nothing stay as they are."""
    cut, lost, out = _dedup(documents, window, part_bytes, range_bytes), F.size("removed") > 0, []
    for i, c in enumerate(documents.columns):
        if c == "text":
            out.append(F.when(lost, F.col("kept")).otherwise(F.col(f"c{i}")).alias(c))
        elif c == "n_chars":
            out.append(F.when(lost, F.length("kept").cast(documents.schema[c].dataType)).otherwise(F.col(f"c{i}")).alias(c))
        else:
            out.append(F.col(f"c{i}").alias(c))
    return cut.where("size(removed) = 0 OR kept <> ''").select(*out)

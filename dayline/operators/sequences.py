"""Row-after-row computations as windows and folds.

Defined cases, where a function states no others: null keys are a key, as in windows; nulls come first in an order;
rows equal in their order stand in any order among themselves; repeated rows count as often as they occur; an
empty table gives no rows; the rows' own columns come back as they are, whatever their names, but for one
that the result's own column replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import scans


def gap_sessions(rows: DataFrame, keys: list[str], at: Column, order: list[str], gap: float, name: str = "session", *, most: int = scans.MOST) -> DataFrame:
    """Number sessions of each key from 1: a row opens one if it is more than gap beyond the row before.

    A row whose at is null opens a session, as does the row after it. Keys of more than `most` rows are scanned in slices.
    """
    (here,) = scans.unused(rows, "at")
    s = scans.Slices(rows.withColumn(here, at), keys, order, most)
    # a null at counts as a row before, so it is carried inside a struct
    s.last(F.struct(F.col(here).alias("x")), upto=-1)
    before = F.col(s.made)["x"]
    opens = F.when(before.isNull() | F.col(here).isNull() | (F.col(here) - before > gap), 1).otherwise(0)
    s.total(opens)
    return s.rows.withColumn(name, F.col(s.made)).select(*[c for c in rows.columns if c != name], name)


def voiced_sessions(frames: DataFrame, frame_ms: int = 20, silence: int = 10) -> DataFrame:
    """Of frames (file, frame_no from 1, is_speech): sessions of speech that at most `silence` silent frames interrupt.

    start_ms counts from the file's start, a frame late; end_frame is the last frame kept, trailing silence included.
    """
    speech = gap_sessions(frames.where("is_speech"), ["file"], F.col("frame_no"), ["frame_no"], silence + 1)
    ends = frames.groupBy("file").agg(F.max("frame_no").alias("_last"))
    found = speech.groupBy("file", "session").agg(F.min("frame_no").alias("first"), F.max("frame_no").alias("last"), F.count(F.lit(1)).alias("n_speech"))
    found = found.join(ends, "file")
    return found.select("file", "session", (F.col("first") * frame_ms).alias("start_ms"), F.col("first").alias("start_frame"), F.least(F.col("last") + silence, F.col("_last")).alias("end_frame"), "n_speech")


class Transfer:
    """What a run of lengths makes of the length open before it: how many chunks begin in it, and the length open behind.

    Where the first chunk of the run begins depends on the length before, what follows only on where that is. So it
    is a small table: of lengths before at least `least`, descending, the chunks and the length open behind; for
    less than all, nothing begins and the lengths add up. It has most + 2 rows at most.
    """

    def __init__(self, lengths: np.ndarray, most: int):
        n = len(lengths)
        ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
        # where the chunk that begins at each row is full: the next chunk begins there
        after = np.maximum(np.searchsorted(ends[1:], ends[:-1] + most, side="right"), np.arange(1, n + 1)).tolist()
        begun, behind, upto = [0] * (n + 1), [0] * (n + 1), int(ends[-1])
        starts = ends.tolist()
        for i in range(n - 1, -1, -1):
            j = after[i]
            begun[i], behind[i] = (1, upto - starts[i]) if j >= n else (1 + begun[j], behind[j])
        # a length before of most - ends[i + 1] + 1 and more is full at row i at the latest
        least = most - ends[1:] + 1
        ahead = np.append(np.iinfo(np.int64).max, least)[:n]
        first = np.flatnonzero((ahead > least) & (ahead > 0))
        self.least = np.maximum(least[first], 0).tolist()
        self.begun, self.behind, self.total = [begun[i] for i in first], [behind[i] for i in first], upto

    def __call__(self, before: int) -> tuple[int, int]:
        return passed(before, self.least, self.begun, self.behind, self.total)


def passed(before: int, least: list[int], begun: list[int], behind: list[int], total: int) -> tuple[int, int]:
    for low, chunks, open_length in zip(least, begun, behind, strict=True):
        if before >= low:
            return chunks, open_length
    return 0, before + total


def chunked(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int = 1000, *, most_rows: int = scans.MOST) -> DataFrame:
    """rows with the chunk (from 0) of each, by key in order: a new chunk begins where the sum of text lengths would pass `most`; an over-long first item leaves an empty chunk before it.

    A partition's rows stream past in order, and only the key, the chunk and its length are held. A key of
    more than most_rows rows is cut to slices: each slice's lengths become a table of what it makes of the
    length open before it (Transfer), the slices' tables stream past in order to tell each its own beginning,
    and then all slices are chunked side by side. A null text has length 0.
    """
    (length,) = scans.unused(rows, "length")
    s = scans.Slices(rows.withColumn(length, F.coalesce(F.length(text), F.lit(0))), keys, order, most_rows)
    part, chunk, opened = s.part, *scans.unused(s.rows, "before", "opened")
    line = s.rows
    if s.hot:
        small = s.of_hot.select(*keys, part, *[c for c in order if c not in keys], length)
        schema = StructType([*[small.schema[c] for c in [*keys, part]], *[StructField(c, ArrayType(LongType())) for c in ("least", "begun", "behind")], StructField("total", LongType())])

        def table(t: pa.Table) -> pa.Table:
            t = t.sort_by([(c, "ascending") for c in order], null_placement="at_start")
            x = Transfer(t[length].to_numpy().astype(np.int64), most)
            row = {c: t[c].slice(0, 1) for c in [*keys, part]} | {c: pa.array([getattr(x, c)], pa.list_(pa.int64())) for c in ("least", "begun", "behind")}
            return pa.table(row | {"total": pa.array([x.total], pa.int64())})

        def seam(batches):
            key, begun, before = None, 0, 0
            for batch in batches:
                out = []
                for row in zip(*[batch[k].to_pylist() for k in [*keys, "least", "begun", "behind", "total"]], strict=True):
                    if row[: len(keys)] != key:
                        key, begun, before = row[: len(keys)], 0, 0
                    out.append((begun, before))
                    chunks, before = passed(before, *row[len(keys) :])
                    begun += chunks
                columns = [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in [*keys, part]], *columns], names=[*keys, part, chunk, opened])

        tables = small.groupBy(*keys, part).applyInArrow(table, schema).repartition(*keys).sortWithinPartitions(*keys, part)
        begins = tables.mapInArrow(seam, StructType([*[small.schema[c] for c in [*keys, part]], StructField(chunk, LongType()), StructField(opened, LongType())]))
        begins = F.broadcast(begins)  # as many rows as slices
        line = line.join(begins, scans.same(line, begins, [*keys, part]), "left").drop(*[begins[c] for c in [*keys, part]])
    else:
        line = line.withColumns({chunk: F.lit(0).cast("long"), opened: F.lit(0).cast("long")})
    names = rows.columns

    def run(batches):
        key, now, size = None, 0, 0
        for batch in batches:
            out = []
            for row in zip(*[batch[k].to_pylist() for k in [*keys, part, length, chunk, opened]], strict=True):
                if row[:-3] != key:
                    key, now, size = row[:-3], row[-2] or 0, row[-1] or 0
                full = size + row[-3] > most
                now, size = now + full, row[-3] + (0 if full else size)
                out.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(out, pa.int32())], names=[*names, "chunk"])

    lined = line.select(*names, length, part, chunk, opened).repartition(*keys, part).sortWithinPartitions(*keys, part, *order)
    return lined.mapInArrow(run, StructType([*rows.schema.fields, StructField("chunk", IntegerType())]))


def pair_rows(rows: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, carry: list[str], *, most: int = scans.MOST) -> DataFrame:
    """Closing rows that come right after an opening row with no closing row between, with columns of that opening row as open_<name>.

    A row that is neither does not part the two; a row that is both opens. Null conditions count as false.
    """
    opened = [F.col(c).alias(f"open_{c}") for c in carry]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"open_{c}") for c in carry]
    (closing,) = scans.unused(rows, "closing")
    s = scans.Slices(rows.withColumn(closing, F.coalesce(closes, F.lit(False))), keys, order, most)
    s.last(F.when(opens, F.struct(F.lit(True).alias("open"), *opened)).when(closes, F.struct(F.lit(False).alias("open"), *none)), upto=-1)
    before = F.col(s.made)
    return s.rows.where(F.col(closing) & before["open"]).select(*rows.columns, *[before[f"open_{c}"].alias(f"open_{c}") for c in carry])


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, missing: str | None = None, *, most: int = scans.MOST) -> DataFrame:
    """The last non-null value up to each row; missing (or null) where there is none yet."""
    s = scans.Slices(rows, keys, order, most)
    s.last(F.col(value))
    last = F.col(s.made) if missing is None else F.coalesce(s.made, F.lit(missing))
    return s.rows.select(*[c for c in rows.columns if c != name], last.alias(name))


def _stem_and_suffix(name: Column) -> tuple[Column, Column]:
    """A name without its extension, and the extension with its dot; dots that begin a name belong to it."""
    pattern = r"(?s)^(\.*.*?)(\.[^.]*)?$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def collision_names(rows: DataFrame, name: str, order: list[str], to: str = "target", taken: DataFrame | None = None, *, most: int = scans.MOST) -> DataFrame:
    """Names made unique: who asks first for a name (by order) has it, the others the first of name_1, name_2, ... before its extension that nobody has.

    A name is had if a row asks for it, or if taken (a column name) holds it; then its first row counts on, too. The number
    of the i-th row that counts on is i and the taken numbers before it: laid out in one line, rows at i and the j-th
    taken number t at t - j, it is a running sum, so neither a name that many rows ask for nor one with many
    numbers taken is held in one place. A null name has a null target.
    """
    (i, pos, kind, row, asked, lost, chosen) = scans.unused(rows, "i", "pos", "kind", "row", "asked", "lost", "chosen")
    s = scans.Slices(rows.where(F.col(name).isNotNull()), [name], order, most)
    s.total(F.lit(1))
    line = s.rows.select(*rows.columns, F.col(s.made).cast("long").alias(i))
    known = rows.select(F.col(name).alias(asked)).where(F.col(asked).isNotNull()).distinct().withColumn(lost, F.lit(0))
    if taken is not None:
        held = taken.select(F.col("name").alias(asked)).where(F.col(asked).isNotNull()).distinct()
        known = known.unionByName(held.withColumn(lost, F.lit(1))).groupBy(asked).agg(F.max(lost).alias(lost))
        line = line.join(held.withColumn(lost, F.lit(1)), F.col(name) == F.col(asked), "left").withColumn(i, F.col(i) - 1 + F.coalesce(lost, F.lit(0))).drop(asked, lost)
    else:
        line = line.withColumn(i, F.col(i) - 1)
    own = line.where(F.col(i) == 0).select(*rows.columns, F.col(name).alias(chosen))
    extra = line.where(F.col(i) > 0).select(F.col(name).alias(asked), F.col(i).alias(pos), F.lit(0).alias(kind), F.struct(*rows.columns).alias(row))

    stem, suffix = _stem_and_suffix(F.col(asked))
    numbered = r"(?s)^(.+)_([1-9][0-9]{0,17})$"
    parent = known.where(stem.rlike(numbered)).select(F.concat(F.regexp_extract(stem, numbered, 1), suffix).alias(asked), F.regexp_extract(stem, numbered, 2).cast("long").alias(pos))
    numbers = scans.Slices(parent, [asked], [pos], most)
    numbers.total(F.lit(1))
    marks = numbers.rows.select(asked, (F.col(pos) - F.col(numbers.made)).alias(pos), F.lit(1).alias(kind), F.lit(None).cast(extra.schema[row].dataType).alias(row))
    both = scans.Slices(extra.unionByName(marks), [asked], [pos, kind], most)
    both.total(F.col(kind))
    stem, suffix = _stem_and_suffix(F.col(asked))
    free = F.concat(stem, F.lit("_"), (F.col(pos) + F.col(both.made)).cast("string"), suffix)
    counted = both.rows.where(F.col(kind) == 0).select(f"{row}.*", free.alias(chosen))
    none = rows.where(F.col(name).isNull()).select("*", F.lit(None).cast("string").alias(chosen))
    return own.union(counted).union(none).withColumn(to, F.col(chosen)).drop(chosen)


def last_written(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order runs from last to first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def split_track(points: DataFrame, keys: list[str], i: str = "i", lng: str = "lng", jump: float = 100.0) -> DataFrame:
    """part 1 or 2 of each point: the second part begins where the step of longitude first changes by more than jump, and is not split again. A key is one track, of some hundred points."""
    step, hit = scans.unused(points, "step", "hit")
    line = Window.partitionBy(*keys).orderBy(i)
    points_ = points.withColumn(step, F.abs(F.col(lng) - F.lag(lng).over(line)))
    points_ = points_.withColumn(hit, F.abs(F.col(step) - F.lag(step).over(line)) > jump)
    first = F.min(F.when(F.col(hit), F.col(i))).over(Window.partitionBy(*keys))
    return points_.withColumn("part", F.when(F.col(i) >= first, 2).otherwise(1)).select(*[c for c in points.columns if c != "part"], "part")

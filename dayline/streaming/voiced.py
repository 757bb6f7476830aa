"""Sessions of voiced frames as a stateful stream, with their true ends: what one pass over each whole file gives, row for row.

Frames of a file can come in any order and more than once. Those next in line are taken as they come, others wait in
the state. A session opens with a voiced frame, keeps up to `silence` silent frames, and is given out once
more silence follows, or at the end of its file: when its end mark and all frames before it have come, or when
the watermark passes the file's last frame by `idle`. Then frames that are missing count as silent.

State is a few numbers for each open file, and 4 bytes for each frame that waits for one before it. A closed
file keeps its number of frames until its timer goes, so that frames that come again open nothing.

Defined cases: a row with null is_speech is the end mark, its frame_no the number of frames; rows with a null file or
frame_no are dropped; of a frame that comes twice the first counts; frames later than the watermark are dropped
by Spark; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SESSION = "file string, session long, start_ms int, start_frame int, end_frame int, n_speech long"
#: done frames (all up to there are taken), sessions so far, and of the open one: first and last voiced frame and how many (0: none is open); the end mark (-1: not yet); waiting frames, 2 * frame_no + is_speech each.
STATE = "done int, session long, first int, last int, n_speech long, ending int, closed boolean, waiting binary"


class Line:
    """One file's frames in order."""

    def __init__(self, state: tuple | None, frame_ms: int, silence: int):
        self.frame_ms, self.silence = frame_ms, silence
        self.done, self.session, self.first, self.last, self.n_speech, self.ending, self.closed, waiting = state or (0, 0, 0, 0, 0, -1, False, b"")
        self.waiting = np.frombuffer(waiting, dtype="<i4")

    def state(self) -> tuple:
        return self.done, self.session, self.first, self.last, self.n_speech, self.ending, self.closed, self.waiting.astype("<i4").tobytes()

    def _out(self, upto: int | None) -> tuple:
        end = self.last + self.silence
        row = self.session, self.first * self.frame_ms, self.first, end if upto is None else min(end, upto), self.n_speech
        self.n_speech = 0
        return row

    def _take(self, frames: np.ndarray, upto: int) -> list[tuple]:
        """Frames in order, all that there are up to the frame upto."""
        out = []
        for no in (frames[(frames & 1) == 1] >> 1).tolist():
            if self.n_speech and no - self.last > self.silence + 1:
                out.append(self._out(None))
            if not self.n_speech:
                self.session, self.first = self.session + 1, no
            self.last, self.n_speech = no, self.n_speech + 1
        self.done = max(self.done, upto)
        if self.n_speech and self.done - self.last > self.silence:
            out.append(self._out(None))
        return out

    def add(self, numbers: np.ndarray, speech: np.ndarray) -> list[tuple]:
        """Frames as they come, a code of -1 for the end mark; sessions that are over."""
        if self.closed:
            return []
        marks = numbers[speech < 0]
        if len(marks):
            self.ending = max(self.ending, int(marks.max()))
        numbers, speech = numbers[speech >= 0].astype(np.int64), speech[speech >= 0]
        codes = np.concatenate([self.waiting.astype(np.int64), 2 * numbers + speech])
        codes = codes[(codes >> 1) > self.done]
        _, at = np.unique(codes >> 1, return_index=True)  # the first that came
        codes = codes[at]
        n = int(np.argmin(np.append((codes >> 1) == self.done + 1 + np.arange(len(codes)), False)))
        out = self._take(codes[:n], self.done + n)
        self.waiting = codes[n:]
        if 0 <= self.ending <= self.done:
            out += self.close()
        return out

    def close(self) -> list[tuple]:
        """The end of the file: what waits is taken, and missing frames are silent."""
        if self.closed:
            return []
        upto = max(self.ending, self.done, int(self.waiting[-1] >> 1) if len(self.waiting) else 0)
        if self.ending >= 0:
            upto = self.ending
            self.waiting = self.waiting[(self.waiting >> 1) <= upto]
        # the last session ends with the file, so its silence is cut there
        voiced = self.waiting[(self.waiting & 1) == 1]
        out = self._take(self.waiting, int(voiced[-1] >> 1) if len(voiced) else self.done)
        if self.n_speech:
            out.append(self._out(upto))
        self.done, self.closed, self.waiting = upto, True, self.waiting[:0]
        return out


def _processor(frame_ms: int, silence: int, idle_ms: int) -> StatefulProcessor:
    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.line = handle.getValueState("line", STATE)

        def _rows(self, key, found: list[tuple]):
            if found:
                yield pd.DataFrame([(key[0], *row) for row in found], columns=["file", "session", "start_ms", "start_frame", "end_frame", "n_speech"]).astype({"start_ms": "int32", "start_frame": "int32", "end_frame": "int32"})

        def handleInputRows(self, key, rows, timerValues):
            line, latest, found = Line(self.line.get(), frame_ms, silence), 0, []
            for frame in rows:
                found += line.add(frame["frame_no"].to_numpy(), frame["speech"].to_numpy())
                latest = max(latest, int(frame["ms"].max()))
            self.line.update(line.state())
            for t in list(self.handle.listTimers()):
                latest = max(latest, t - idle_ms)
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + idle_ms)
            yield from self._rows(key, found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            line = Line(self.line.get(), frame_ms, silence)
            found = line.close()
            self.line.clear()
            yield from self._rows(key, found)

        def close(self) -> None:
            pass

    return Sessions()


def voiced_sessions(frames: DataFrame, *, frame_ms: int = 20, silence: int = 10, late: str = "10 seconds", idle_ms: int = 10_000) -> DataFrame:
    """Of a stream of frames (file, frame_no from 1, is_speech, ts): what sequences.voiced_sessions gives of the files, each session once it is over.

    ts may be late by `late`; a file whose frames stop for idle_ms beyond that is over. The session must use the RocksDB state store.
    """
    code = F.coalesce(F.col("is_speech").cast("int"), F.lit(-1)).cast("byte").alias("speech")
    rows = frames.withWatermark("ts", late).where("file IS NOT NULL AND frame_no IS NOT NULL")
    rows = rows.select("file", F.col("frame_no").cast("int").alias("frame_no"), code, F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("file").transformWithStateInPandas(_processor(frame_ms, silence, idle_ms), outputStructType=SESSION, outputMode="append", timeMode="eventTime")

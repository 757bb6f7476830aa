"""Chat formatting: a hidden Markov model over speaker markers and line features recovers the roles of a transcript's lines by Viterbi; turns are rendered in one canonical form.

States are (role, first line of a turn or a later one). A line shows a marker (the role it names, a
bare change of speaker, or none) and a shape. The chances of states to follow each other and to show
markers and shapes are counted from a bounded sample of transcripts with known roles, on top of
prior counts, so that a model without a sample works too.

A transcript may come in parts of bounded length, so a conversation of any length spreads over tasks. It
is decoded as one: each part gives the best score from every state before it to every state at its end,
a small table of numbers; these are put together in the order of the parts, which gives the state that
the best path of the whole transcript has at each seam; then each part follows its piece of that path.

Defined cases: a null or empty transcript has no turns; lines before any marker belong to the most
likely role; a role word that is no known alias is no marker; role tags of the canonical form inside
a text are broken by a space; a line of a turn's text that begins as a speaker marker does can't be told from
one and begins a turn of its own; a conversation whose id and part repeat is decoded with the repeated
parts one after another; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, stored

ROLES = ("system", "user", "assistant")
# Words that name a role in a speaker marker.
ALIASES = {
    "system": "system", "sys": "system", "context": "system", "instructions": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant", "gpt": "assistant", "model": "assistant", "response": "assistant",
}
_NAMED = (
    re.compile(r"\s*[*_\[(<|#]{0,4}\s*([A-Za-z]+)\s*[*_\])>|]{0,4}\s*:[*_]{0,2} ?"),
    re.compile(r"\s*(?:\[|<\|?)\s*([A-Za-z]+)\s*(?:\]|\|?>) ?"),
    re.compile(r"\s*#{1,6}\s*([A-Za-z]+)\s*$"),
)
_CHANGE = re.compile(r"\s*[-–—>] ")
MARKERS = (*ROLES, "change", "none")
SHAPES = ("blank", "question", "short", "long", "code")
STATES = [(r, first) for r in ROLES for first in (True, False)]


def marker(line: str) -> tuple[str, int]:
    """What marker a line begins with, and where its text begins."""
    for pattern in _NAMED:
        m = pattern.match(line)
        if m and m[1].lower() in ALIASES:
            return ALIASES[m[1].lower()], m.end()
    m = _CHANGE.match(line)
    return ("change", m.end()) if m else ("none", 0)


def line_shape(text: str) -> str:
    t = text.strip()
    if not t:
        return "blank"
    if t.startswith("```") or text.startswith("    ") or t[-1] in "{};":
        return "code"
    return "question" if t.endswith("?") else "long" if len(t) > 120 else "short"


class Model:
    """Log chances: begin (states), follow (states by states), shows (states by markers), looks (states by shapes)."""

    def __init__(self, begin: Counter | None = None, follow: Counter | None = None, shows: Counter | None = None, looks: Counter | None = None):
        n = len(STATES)
        b, t, m, s = np.zeros(n), np.zeros((n, n)), np.zeros((n, len(MARKERS))), np.ones((n, len(SHAPES)))
        for i, (role, first) in enumerate(STATES):
            b[i] = {"system": 3.0, "user": 6.0, "assistant": 1.0}[role] if first else 1e-6
            for j, (other, other_first) in enumerate(STATES):
                t[i, j] = (6.0 if other == role else 1e-6) if not other_first else {"system": 0.1, "user": 1.0, "assistant": 1.0}[other] * (0.1 if other == role else 1.0)
            for k, shown in enumerate(MARKERS):
                m[i, k] = (20.0 if shown == role else 2.0 if shown == "change" else 1.0 if shown == "none" else 1e-3) if first else (40.0 if shown == "none" else 0.3 if shown == "change" else 1e-3)
        for counts, into in ((begin, b), (follow, t), (shows, m), (looks, s)):
            for at, c in (counts or {}).items():
                into[at] += c
        self.begin, self.follow, self.shows, self.looks = (np.log(x / x.sum(axis=-1, keepdims=True)) for x in (b, t, m, s))

    def viterbi(self, seen: list[tuple[int, int]], before: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states of lines that show (marker, shape): after a line in state before, or at the beginning, and up to a line in state last, or any."""
        back = []
        score = (self.begin if before is None else self.follow[before]) + self.shows[:, seen[0][0]] + self.looks[:, seen[0][1]]
        for k, s in seen[1:]:
            step = score[:, None] + self.follow
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + self.shows[:, k] + self.looks[:, s]
        path = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def across(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """The best score of lines from each state of the line before them (the last row: from the beginning) to each state of their last line."""
        score = np.vstack([self.follow, self.begin]) + (self.shows[:, seen[0][0]] + self.looks[:, seen[0][1]])
        for k, s in seen[1:]:
            score = (score[:, :, None] + self.follow).max(axis=1) + (self.shows[:, k] + self.looks[:, s])
        return score


def observe(line: str) -> tuple[int, int, int]:
    shown, at = marker(line)
    return MARKERS.index(shown), SHAPES.index(line_shape(line[at:])), at


def seams(tables: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """Of the parts of one transcript, by their tables of across(): the state before each part (none before the first) and that of its last line, on the best path of the whole."""
    score, back = tables[0][-1], []
    for t in tables[1:]:
        step = score[:, None] + t[:-1]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([None, *ends[:-1]], ends, strict=True))


def parse(transcript: str | None, model: Model, before: int | None = None, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn; of a part of a transcript, between the states at its seams. A part that begins inside a turn begins with the rest of it, as a turn of its own."""
    if not transcript:
        return []
    lines = transcript.split("\n")
    seen = [observe(x) for x in lines]
    turns: list[tuple[str, list[str]]] = []
    for line, (_, _, at), state in zip(lines, seen, model.viterbi([x[:2] for x in seen], before, last), strict=True):
        role, first = STATES[state]
        if first or not turns:
            turns.append((role, [line[at:]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(x)) for role, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: each turn between role tags."""
    safe = ((r, t.replace("<|im_", "< |im_")) for r, t in turns)
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in safe)


def train(known: list[list[tuple[str, str]]], styles: list[dict[str, str]]) -> Model:
    """Counts from conversations of (role, text), written in each of the marker styles in turn."""
    begin, follow, shows, looks = Counter(), Counter(), Counter(), Counter()
    for n, turns in enumerate(known):
        style, before = styles[n % len(styles)], None
        for role, text in turns:
            if role not in ROLES:
                continue
            for i, line in enumerate(f"{style[role]}{text or ''}".split("\n")):
                state = STATES.index((role, i == 0))
                k, s, _ = observe(line)
                if before is None:
                    begin[state] += 1
                else:
                    follow[before, state] += 1
                shows[state, k] += 1
                looks[state, s] += 1
                before = state
    return Model(begin, follow, shows, looks)


#: Speaker markers that transcripts are written with.
STYLES = [
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Context: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "**System:** ", "user": "**Question:** ", "assistant": "**Answer:** "},
    {"system": "<|system|> ", "user": "<|prompter|> ", "assistant": "<|model|> "},
]

TURNS = "array<struct<role: string, text: string>>"


def transcripts(conversations: DataFrame, *, part_turns: int = 128) -> DataFrame:
    """conv_id, part and transcript: the turns of a conversation in order, in parts of part_turns numbers of turns, each turn behind the speaker marker of the conversation's style; a turn without a known role has a bare dash."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("- ")
    for n, s in enumerate(STYLES):
        for role, text in s.items():
            mark = F.when((style == n) & (F.col("role") == role), F.lit(text)).otherwise(mark)
    line = F.concat(mark, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / part_turns).alias("part"), line.alias("line"))
    turns = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return turns.select("conv_id", "part", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def learn(conversations: DataFrame, *, max_turns: int = 4000, max_bytes: int = 16 << 20) -> Model:
    """A model from at most max_turns turns with known roles, those of conversations with the smallest hashes, and of them, texts over 1 MB (common.MAX_TEXT) apart, the first that hold max_bytes of text together."""
    order = [F.xxhash64("conv_id"), "conv_id", "turn", F.xxhash64("role", "text")]
    rows = conversations.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    rows = rows.orderBy(*order).limit(max_turns)
    rows = sampled(rows, order, max_bytes).collect()
    known: dict = {}
    for r in rows:
        known.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return train(list(known.values()), STYLES)


def _tables(model: Model):
    def run(batches):
        for batch in batches:
            found = []
            for t in batch["transcript"]:
                text = t.as_py()
                found.append(model.across([observe(x)[:2] for x in text.split("\n")]).astype("<f8").tobytes() if text else None)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], batch["n"], pa.array(found, pa.binary())], names=["conv_id", "part", "n", "scores"])

    return run


def _seams(table: pa.Table) -> pa.Table:
    """Of one conversation's parts, a small table of numbers for each: the states at their seams."""
    table = table.sort_by([("part", "ascending"), ("n", "ascending")])
    states = len(STATES)
    met = seams([np.frombuffer(x.as_py(), "<f8").reshape(states + 1, states) for x in table["scores"]])
    return table.select(["n"]).append_column("before", pa.array([b for b, _ in met], pa.int32())).append_column("last", pa.array([e for _, e in met], pa.int32()))


def format_chats(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (conv_id, part, transcript) to conv_id, part, turns, rendered and first_turn, the number of turns in the parts before. The parts of a conversation are read as one transcript."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"), F.col("transcript").cast("string").alias("transcript"))
    several = rows.where("transcript <> ''").groupBy(F.col("conv_id").alias("long_id")).agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    if several.isEmpty():
        return _formatted(rows.withColumns({"before": F.lit(None).cast("int"), "last": F.lit(None).cast("int")}), model).withColumn("first_turn", F.lit(0).cast("long"))
    rows = stored(rows.withColumn("n", F.monotonically_increasing_id()), "transcript-parts")
    long = rows.where("transcript <> ''").join(several, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    met = long.select("conv_id", "part", "n", "transcript").mapInArrow(_tables(model), "conv_id long, part long, n long, scores binary")
    met = met.groupBy("conv_id").applyInArrow(_seams, "n long, before int, last int")
    done = stored(_formatted(rows.join(met, "n", "left"), model), "formatted-parts")
    ahead = Window.partitionBy("conv_id").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    first = done.select("conv_id", "part", "n", F.size("turns").alias("n_turns")).select("n", F.coalesce(F.sum("n_turns").over(ahead), F.lit(0)).alias("first_turn"))
    return done.join(first, "n").drop("n")


def _formatted(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, turns and rendered (and n, if rows are numbered) of parts with the states at their seams."""
    numbered = "n" in rows.columns
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("rendered", pa.string()), *([("n", pa.int64())] if numbered else [])])

    def run(batches):
        for batch in batches:
            found = [parse(t.as_py(), model, b, e) for t, b, e in zip(batch["transcript"], batch["before"].to_pylist(), batch["last"].to_pylist(), strict=True)]
            turns = [[{"role": r, "text": t} for r, t in x] for x in found]
            columns = [batch["conv_id"], batch["part"], pa.array(turns, schema.field("turns").type), pa.array([render(x) for x in found], pa.string()), *([batch["n"]] if numbered else [])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("conv_id", "part", "transcript", "before", "last", *(["n"] if numbered else [])).mapInArrow(run, f"conv_id long, part long, turns {TURNS}, rendered string" + ", n long" * numbered)

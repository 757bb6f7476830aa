"""Quality by weak labels: expectation-maximisation over overlapping heuristic labellers, and a hashed linear scorer of the posterior labels.

Each labeller looks at one measure of a text and votes bad beyond its bound or abstains; one more
votes good where all measures are ordinary. The label model takes each to have its own rates of
votes in each class and estimates them, with the class rate, by expectation-maximisation from the
votes on all texts; no quality label is learned. The posterior
labels of a sample train a logistic scorer over hashed features of the text: token shapes, their
successions, repeats, and the measures in steps.

Every document votes, on the executors, and the label model is fitted on the counts of the patterns
of votes: a vote is cast or not, so there are at most 2 ** 11. The scorer is fitted on the driver on at
most max_rows documents: a quarter of them dealt evenly to the patterns, the rest by their counts,
those with the smallest hashes of id and text, and of them, texts over 1 MB (common.MAX_TEXT) apart,
the first max_bytes of text at most. Scoring runs on the executors over whole texts.

Defined cases: a null text is empty; an empty text has the measures of no words and is scored like
any other; repeated rows come back as often as they occur; an empty table gives no rows; other
columns stay unused.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, stored

#: Number of hashed features.
BUCKETS = 1 << 14
GOOD, BAD, NONE = 1, 0, -1

#: Kinds of characters up to U+024F: 1 small letter, 2 capital, 3 digit, 4 white space, 5 mark; later ones count as small letters.
_KIND = np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 for c in map(chr, range(0x250))] + [1], dtype=np.uint8)

_RUNS = ((re.compile(r"[^\W\d_]*[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0"))


def shape(word: str) -> str:
    """The word's runs of letters, capitals and digits as one sign each, other characters as they are; the first and last 3 signs of more than 6."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word if len(word) <= 6 else word[:3] + word[-3:]


class _Shapes(dict):
    def __missing__(self, word: str) -> str:
        s = shape(word)
        if len(self) < 100_000:
            self[word] = s
        return s


_KNOWN = _Shapes()


class Look:
    """One look at a whole text: its measures, its token shapes and their pairs."""

    def __init__(self, text: str | None):
        text = text or ""
        words = text.split()
        shapes = list(map(_KNOWN.__getitem__, words))
        self.shapes, self.pairs = Counter(shapes), Counter(zip(["", *shapes], shapes, strict=False))
        n = self.n = max(1, len(words))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = np.bincount(_KIND[np.minimum(points, 0x250)], minlength=6)
        lines = Counter(x for x in text.split("\n") if x.strip())
        letters = int(kinds[1] + kinds[2])
        self.measures = {
            "words": float(len(words)),
            "same": sum(map(eq, words, words[1:])) / n,
            "distinct": len(set(words)) / math.sqrt(n),
            "marks": int(kinds[5]) / max(1, len(text)),
            "upper": int(kinds[2]) / max(1, letters),
            "letters": letters / max(1, len(text)),
            "tables": self.shapes["|"] / n,
            "length": (len(text) - int(kinds[4])) / n,
            "lines": sum(c for c in lines.values() if c > 1) / max(1, sum(lines.values())),
            "ends": sum(c for s, c in self.shapes.items() if s[-1] in ".!?") / n,
            "tails": sum(c for s, c in self.shapes.items() if len(s) > 2 and not s[-1].isalnum() and not s[-2].isalnum()) / n,
        }


#: Labellers of bad texts: measure, side, bound, and the words that a text must have for a vote. Fixed values.
LABELLERS = [
    ("same", ">", 0.08, 12),
    ("distinct", "<", 2.0, 30),
    ("marks", ">", 0.08, 12),
    ("upper", ">", 0.40, 12),
    ("tables", ">", 0.05, 0),
    ("letters", "<", 0.64, 12),
    ("tails", ">", 0.25, 4),
    ("lines", ">", 0.50, 12),
    ("ends", ">", 0.60, 12),
    ("length", ">", 9.0, 30),
]
#: What the labeller of good texts asks of the measures: within these bounds.
ORDINARY = {"same": (0.0, 0.08), "marks": (0.0, 0.06), "upper": (0.0, 0.20), "tables": (0.0, 0.0), "letters": (0.64, 1.0), "tails": (0.0, 0.10)}


def votes(m: dict[str, float]) -> list[int]:
    out = [BAD if m["words"] >= least and (m[name] > bound if side == ">" else m[name] < bound) else NONE for name, side, bound, least in LABELLERS]
    return [*out, GOOD if all(low <= m[k] <= high for k, (low, high) in ORDINARY.items()) else NONE]


def posterior(table: np.ndarray, count: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Of votes (rows by labellers, each standing for count documents): the probability of class good, by expectation-maximisation with rates of bad, good and no vote for each labeller and class."""
    if not len(table):
        return np.empty(0)
    count = np.ones(len(table)) if count is None else count
    kinds = np.stack([table == BAD, table == GOOD, table == NONE], axis=2).astype(float)
    post = np.where((table == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        n_good, n_bad = float(count @ post), float(count @ (1 - post))
        rate = (n_good + 1) / (count.sum() + 2)
        good = (np.einsum("r,rlk->lk", count * post, kinds) + 0.1) / (n_good + 0.3)
        bad = (np.einsum("r,rlk->lk", count * (1 - post), kinds) + 0.1) / (n_bad + 0.3)
        logit = np.log(rate / (1 - rate)) + np.einsum("rlk,lk->r", kinds, np.log(good / bad))
        now = 1 / (1 + np.exp(-logit.clip(-30, 30)))
        if np.abs(now - post).max() < 1e-5:
            break
        post = now
    return now


def pattern(cast: list[int]) -> int:
    """The votes as bits: each labeller votes for one class or not at all."""
    return sum(1 << i for i, v in enumerate(cast) if v != NONE)


def cast(patterns: np.ndarray) -> np.ndarray:
    """The votes of patterns, rows by labellers."""
    bits = patterns[:, None] >> np.arange(len(LABELLERS) + 1) & 1
    return np.where(bits == 1, np.array([BAD] * len(LABELLERS) + [GOOD]), NONE)


def quotas(count: np.ndarray, max_rows: int) -> np.ndarray:
    """Rows for each pattern, max_rows at most in all: a quarter of them dealt evenly, the rest by the counts left; of more patterns than rows, the most frequent have one each."""
    if count.sum() <= max_rows:
        return count.astype(np.int64)
    if len(count) >= max_rows:
        out = np.zeros(len(count), dtype=np.int64)
        out[np.argsort(-count, kind="stable")[:max_rows]] = 1
        return out
    out = np.minimum(count, max(1, max_rows // 4 // len(count))).astype(np.int64)
    left = count - out
    return out + (left * ((max_rows - out.sum()) / left.sum())).astype(np.int64)


def hashed(look: Look) -> dict[int, float]:
    """Hashed features: roots of the shares of token shapes and of pairs of shapes, and the measures in steps."""
    out: dict[int, float] = {}
    for f, c in chain(look.shapes.items(), ((f"{a} {b}", c) for (a, b), c in look.pairs.items())):
        k = zlib.crc32(f.encode()) % BUCKETS
        out[k] = out.get(k, 0.0) + math.sqrt(c / look.n)
    for name, x in look.measures.items():
        step = int(round(4 * math.log2(1 + abs(x) * 64)))
        for s in (f"{step // 2}/2", f"{step // 4}/4"):
            k = zlib.crc32(f"{name}={s}".encode()) % BUCKETS
            out[k] = out.get(k, 0.0) + 1.0
    return out


def train_scorer(rows: list[dict[int, float]], target: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and the constant, by passes of adaptive gradient steps over the rows."""
    w, scale, constant, own = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    packed = [(np.fromiter(r, dtype=np.int64, count=len(r)), np.fromiter(r.values(), dtype=float, count=len(r))) for r in rows]
    order = np.random.default_rng(7)
    for _ in range(rounds if rows else 0):
        for i in order.permutation(len(packed)):
            k, x = packed[i]
            g = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(w[k] @ x) + constant)))) - target[i]
            step = g * x + ridge * w[k]
            scale[k] += step * step
            w[k] -= rate * step / np.sqrt(scale[k])
            own += g * g
            constant -= rate * g / math.sqrt(own)
    return w, constant


def fit(texts: list[str | None]) -> tuple[np.ndarray, float]:
    looks = [Look(t) for t in texts]
    post = posterior(np.array([votes(x.measures) for x in looks]).reshape(len(texts), len(LABELLERS) + 1))
    return train_scorer([hashed(x) for x in looks], post)


def train(documents: DataFrame, *, max_rows: int = 3000, max_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    @F.arrow_udf("int")
    def voted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([pattern(votes(Look(t.as_py()).measures)) for t in texts], pa.int32())

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = stored(rows.select("doc_id", F.xxhash64("text").alias("h"), voted(F.col("text")).alias("pattern")), "votes")
    counted = dealt.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # 2 ** 11 at most
    patterns, n = (np.array([r[k] for r in counted], dtype=np.int64) for k in ("pattern", "n"))
    post = posterior(cast(patterns), n.astype(float))

    named = dealt.where("doc_id is not null").distinct().withColumn("u", F.xxhash64("doc_id", "h"))
    sizes = named.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    n = np.array([r["n"] for r in sizes], dtype=np.int64)
    quota = quotas(n, max_rows)
    # twice the quota and 50 rows are let through by their hashes, so that no pattern is sorted whole
    upto = [int(min(1.0, (2 * q + 50) / m) * (2**64 - 1)) - 2**63 for q, m in zip(quota.tolist(), n.tolist(), strict=True)]
    shares = documents.sparkSession.createDataFrame([(r["pattern"], q, min(u, 2**63 - 1)) for r, q, u in zip(sizes, quota.tolist(), upto, strict=True)], "pattern int, quota long, upto long")
    by_hash = Window.partitionBy("pattern").orderBy("u", "doc_id", "h")
    chosen = named.join(F.broadcast(shares), "pattern").where("u <= upto").withColumn("at", F.row_number().over(by_hash)).where("at <= quota").select("doc_id", "h", "pattern", "u")
    sample = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    sample = sampled(sample.select("text", "pattern", "u", "doc_id", "h"), ["u", "doc_id", "h"], max_bytes).select("text", "pattern").collect()
    return train_scorer([hashed(Look(r["text"])) for r in sample], post[np.searchsorted(patterns, [r["pattern"] for r in sample])])


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of documents, and quality double (in place of a column of that name): the probability that the text is good."""
    w, constant = model

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            logits = (constant + sum(w[k] * x for k, x in hashed(Look(t.as_py())).items()) for t in texts)
            yield pa.array([1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in logits], pa.float64())

    return documents.withColumn("quality", quality(F.col("text").cast("string")))

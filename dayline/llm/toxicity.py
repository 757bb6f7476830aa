"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier on its posterior labels.

Voters are words (lexicon) and word beginnings that one, two or three different words of a text have
(patterns), found one by one as the most telling feature of the labelled texts, which count less where
earlier voters fire; one more voter fires where no other does. A voter votes where it fires and abstains
elsewhere. The label model estimates each voter's rates in both classes by expectation-maximisation and
measures how voters correlate within the classes; voters that fire on the same text share their weight as
far as they correlate, one that fires alone keeps it whole. The posterior labels of the sample train a
logistic classifier on the same kinds of features, which scores whole texts.

The sample holds at most max_rows labelled rows, those with the smallest hashes of their ids, and of
them the first max_bytes of text at most; a text over 1 MB (common.MAX_TEXT) is scored, but not in the
sample. It is fitted on the driver, and everything else runs on the executors.

Defined cases: a null text is empty; an empty text has the score of no features at all; a row
without label, or with a null one, does not train; with no usable labels, or none of one class,
every score is the class rate (0 without labels); a null doc_id is held out if its crc32 as an empty
text says so; repeated rows come back as often as they occur, and a labelled id with several texts trains
with one of them, the first by hash; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, sampled

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that can be patterns.
STEMS = (3, 4, 5, 6, 7, 8)
#: Up to so many different words of a text with one beginning are told apart.
LEVELS = 3
#: Features in fewer texts of the sample are left out.
LEAST = 4


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def feature_name(base: str, level: int) -> str:
    """base alone for one word, with 2 or 3 behind it for so many."""
    return f"{base}{level + 1}" if level else base


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Bags:
    """The features of each text as numbers, and their names: a feature that n words of the text have stands there at all levels up to n."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        of_word: dict[str, np.ndarray] = {}
        rows = [np.empty(0, dtype=np.int32)]
        for text in texts:
            found = []
            for w in words_of(text):
                if w not in of_word:
                    of_word[w] = np.array([number.setdefault(f, len(number)) for f in word_features(w)], dtype=np.int32)
                found.append(of_word[w])
            bag, n = np.unique(np.concatenate([*found, rows[0]]), return_counts=True)
            rows.append(np.concatenate([LEVELS * bag[n > level] + level for level in range(LEVELS)]).astype(np.int32))
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in rows[1:]])
        feature = np.concatenate(rows)
        often = np.bincount(feature, minlength=LEVELS * len(number)) >= LEAST
        place, bases = np.cumsum(often) - 1, list(number)
        self.names = [feature_name(bases[f // LEVELS], f % LEVELS) for f in np.flatnonzero(often)]
        self.row, self.feature = row[often[feature]], place[feature[often[feature]]]
        self.n_rows = len(texts)

    def counts(self, target: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each feature: the rows that hold it, and their sum of target."""
        inside = rows[self.row]
        f = self.feature[inside]
        return np.bincount(f, minlength=len(self.names)), np.bincount(f, weights=target[self.row[inside]], minlength=len(self.names))

    def holds(self, features: list[int]) -> np.ndarray:
        out = np.zeros((self.n_rows, len(features)), dtype=np.float32)
        place = np.full(len(self.names), -1)
        place[features] = np.arange(len(features))
        at = place[self.feature]
        out[self.row[at >= 0], at[at >= 0]] = 1
        return out


def surprise(n: np.ndarray, ones: np.ndarray, rate: float) -> np.ndarray:
    """Standard deviations by which class 1 is commoner among the rows of a feature than among all."""
    return (ones - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))


def pick_voters(bags: Bags, target: np.ndarray, most: int = 120, least: int = LEAST, edge: float = 6.0) -> tuple[list[int], np.ndarray]:
    """Voters one by one, each the most surprising feature while rows count half for each earlier voter that fires there.

    Also returns which features fire, in nine cases of ten, where one voter does; they are not picked.
    """
    weight = np.ones(bags.n_rows)
    out: list[int] = []
    length = np.array([len(f.rstrip("*23")) for f in bags.names])
    every = np.ones(bags.n_rows, dtype=bool)
    total, all_ones = bags.counts(target, every)
    rate = max(float(target.mean()), 1e-6)
    doubtful = (all_ones < least) | (all_ones < 0.8 * total)
    echo = np.zeros(len(bags.names), dtype=bool)
    while len(out) < most:
        n, ones = (np.bincount(bags.feature, weights=w[bags.row], minlength=len(bags.names)) for w in (weight, weight * target))
        z = np.where(doubtful | echo, 0.0, surprise(n, ones, rate))
        best = np.flatnonzero(z >= z.max() - 1e-9)
        if z[best[0]] < edge:
            break
        f = int(best[np.argmax(length[best])])
        out.append(f)
        rows = np.zeros(bags.n_rows, dtype=bool)
        rows[bags.row[bags.feature == f]] = True
        echo |= bags.counts(target, rows)[0] >= 0.9 * total
        weight[rows] *= 0.5
    return out, echo


class LabelModel:
    """Votes (rows by voters, 1 where a voter fires) to posterior labels."""

    def __init__(self, prior: float, rounds: int = 30):
        self.prior, self.rounds = prior, rounds

    def fit(self, votes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: a first guess at the labels. Returns the posterior of class 1."""
        post = first.astype(float)
        strength = 1.0
        for _ in range(self.rounds):
            self.rate1 = (votes.T @ post + 0.5 * strength) / (post.sum() + strength)
            self.rate0 = (votes.T @ (1 - post) + 0.1 * strength) / ((1 - post).sum() + strength)
            self.correlation = self._correlation(votes, post)
            self.alike = np.clip((self.correlation - 0.1) / 0.9, 0, 1)  # small correlations come by chance
            np.fill_diagonal(self.alike, 1)
            now = self.posterior(votes)
            if np.abs(now - post).max() < 1e-4:
                break
            post = now
        return self.posterior(votes)

    def _correlation(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """How voters correlate inside the classes."""
        rest = votes - np.outer(post, self.rate1) - np.outer(1 - post, self.rate0)
        cov = rest.T @ rest / max(1, len(votes))
        sd = np.sqrt(np.diag(cov)) + 1e-9
        return cov / np.outer(sd, sd)

    @property
    def share(self) -> np.ndarray:
        """Each voter's share where all that correlate with it fire too."""
        return 1 / self.alike.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Each vote counts by its share among the votes on the same row that correlate with it."""
        fires = np.log(self.rate1.clip(1e-6, 1) / self.rate0.clip(1e-6, 1))
        logit = np.log(self.prior / (1 - self.prior)) + (votes / np.maximum(votes @ self.alike, 1)) @ fires
        return 1 / (1 + np.exp(-logit.clip(-30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, rounds: int = 25) -> np.ndarray:
    """Weights of soft labels y, the last one the constant, by Newton steps."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(texts: list[str | None], labels: list[int], *, most_features: int = 200) -> tuple[dict[str, float], float]:
    """Weights of features and the constant, from labelled texts."""
    y = np.array(labels, dtype=float)
    rate = (float(y.sum()) + 1e-3) / (len(y) + 2e-3) if len(y) else 1e-6
    bags = Bags(texts)
    voters, echo = pick_voters(bags, y) if 0 < y.sum() < len(y) else ([], None)
    if not voters:
        return {}, float(np.log(rate / (1 - rate)).clip(-14, 14))
    votes = bags.holds(voters).astype(float)
    votes = np.hstack([votes, (votes.sum(axis=1, keepdims=True) == 0)])
    posterior = LabelModel(rate).fit(votes, y)
    n, ones = bags.counts(posterior, np.ones(bags.n_rows, dtype=bool))
    z = np.where((n >= LEAST) & ~echo, np.abs(surprise(n, ones, float(posterior.mean()))), 0)
    names = list(dict.fromkeys([*voters, *(f for f in np.argsort(-z, kind="stable")[:most_features].tolist() if z[f] > 0)]))
    w = logistic(bags.holds(names), posterior)
    return {bags.names[f]: float(v) for f, v in zip(names, w[:-1], strict=True) if abs(v) > 1e-4}, float(w[-1])


def sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, train: Column) -> list:
    """At most max_rows labelled rows (text, y) for which train holds, by the smallest hashes of their ids, and of them, texts over MAX_TEXT bytes apart, as many as hold max_bytes of text together."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows bounds it
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sampled(rows, [F.xxhash64("doc_id"), "doc_id"], max_bytes).select("text", "y").collect()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Scorer:
    """Scores of texts by the weights; remembers the weights of words."""

    def __init__(self, weights: dict[str, float], constant: float, most: int = 100_000):
        self.constant, self.most = constant, most
        self.steps = {b: [weights.get(feature_name(b, level), 0.0) for level in range(LEVELS)] for b in sorted({f.rstrip("23") for f in weights})}
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> float:
        hits: dict[str, int] = {}
        known, steps = self.known, self.steps
        for w in words_of(text):
            found = known.get(w)
            if found is None:
                found = tuple(f for f in word_features(w) if f in steps)
                if len(known) < self.most:
                    known[w] = found
            for f in found:
                hits[f] = hits.get(f, 0) + 1
        total = self.constant + sum(sum(steps[f][: hits[f]]) for f in sorted(hits))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, total))))


def score_of(text: Column, model: tuple[dict[str, float], float]) -> Column:
    """The score of a text. Only texts go to Python and only scores come back."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*model)
        for texts in batches:
            yield pa.array([scorer(t.as_py()) for t in texts], pa.float64())
        scorer = texts = None
        release()

    return toxicity(text.cast("string"))


def score(documents: DataFrame, model: tuple[dict[str, float], float], column: str = "toxicity") -> DataFrame:
    """All columns of documents, and the score as a double, which takes the place of a column of its name."""
    return documents.withColumn(column, score_of(F.col("text"), model))


def drop_toxic(documents: DataFrame, model: tuple[dict[str, float], float], threshold: float = 0.5) -> DataFrame:
    """The rows of documents, with their columns as they are, whose text scores below the threshold."""
    return documents.where(score_of(F.col("text"), model) < threshold)


def train(documents: DataFrame, labels: DataFrame, *, max_rows: int = 4000, max_bytes: int = 64 << 20) -> tuple[dict[str, float], float]:
    rows = sample(documents, labels, "toxic", max_rows, max_bytes, ~held_out())
    return fit([r["text"] for r in rows], [r["y"] for r in rows])

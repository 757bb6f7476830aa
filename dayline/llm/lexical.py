"""Ranked lexical search by sort-based accumulation: the impacts of matched terms are laid out as arrays of (item, document, impact), their packed keys radix sorted, and equal keys summed.

1. Items are dealt to blocks of a checked size (BLOCK_BYTES of terms), and blocks to groups (GROUP_BYTES). A group's
   distinct terms are sent out for one reading of all texts; its matches (numbers of terms and how often
   they occur) are a written table, from which the corpus statistics are counted. Each of its blocks is one
   reading of that table. The driver holds one group's distinct terms and one block's items at a time.
2. Each task takes the documents of its range of that table, some at a time, concatenates the impacts of all
   their matches for all items that have the term, sorts the keys (item, document) digit by digit, and
   sums runs of equal keys. A document's score is complete in its task, so no score is shuffled.
3. Of each item a task keeps the best k in a heap and gives these out; the best k of all tasks remain. Rows that
   leave tasks follow the items and the tasks, never the pairs, and a frequent term is no hot key.

Scores are whole numbers: a term's weight times (10^9 tf) div (1000 tf + 8 m), m by the document's length.

Defined cases: a null or empty text has no terms and is not counted; rows are documents, so repeated ones are
ranked beside each other; a document with a null id is ranked, after others of its score; repeated item rows
count once, and texts that share an item_id (null is one too) are one item; an item without terms, or whose terms no document
has, gives no rows; empty tables give no rows; other columns are not used.
"""

from __future__ import annotations

import heapq
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .decontam import words_of

#: Terms of items that one broadcast holds at most, in bytes, each counted for every item that has it.
BLOCK_BYTES = 8 << 20
#: Terms that one reading of the texts looks for at most, counted in the same way.
GROUP_BYTES = 64 << 20
#: Impacts that are sorted at once (more if one document has more).
IMPACTS = 1 << 21
#: Documents whose impacts are sorted at once at most; their numbers are the low digit of the keys.
DOCUMENTS = 1 << 16
#: Share of a document's length in its m, in percent.
LENGTH = 75


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers that are not negative, by digits of 16 bits, lowest first."""
    order, shift = None, 0
    most = int(key.max(initial=0))
    while order is None or most >> shift:
        digit = (key >> np.uint64(shift)).astype(np.uint16)
        if order is None:
            ordered = bool((digit[1:] >= digit[:-1]).all())
            order = np.arange(len(key)) if ordered else np.argsort(digit, kind="stable")
        else:
            order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


class Index:
    """Of each term number: the items that have it, and how often."""

    def __init__(self, term: np.ndarray, item: np.ndarray, times: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.start = np.append(0, np.cumsum(np.bincount(term, minlength=n_terms)))

    def accumulate(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document (below DOCUMENTS) and score of every pair with a score above 0, by item, then document."""
        first, n = self.start[term], self.start[term + 1] - self.start[term]
        of = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
        key = (self.item[at].astype(np.uint64) << np.uint64(16)) | doc[of].astype(np.uint64)
        gain = impact[of] * self.times[at]
        order = radix_order(key)
        key, gain = key[order], gain[order]
        if not len(key):
            return key.astype(np.int64), key.astype(np.int64), gain
        run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        score, key = np.add.reduceat(gain, run), key[run]
        item, doc = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(DOCUMENTS - 1)).astype(np.int64)
        return item[score > 0], doc[score > 0], score[score > 0]


class Best:
    """The k best of each item: a heap whose root is the worst."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.floor = np.zeros(n_items, dtype=np.int64)  # scores below can't enter

    def offer(self, item: np.ndarray, score: np.ndarray, lost: np.ndarray, doc_id: np.ndarray) -> None:
        """lost: 1 if the id is null. A higher score is better, then an id that is not null, then a smaller one."""
        some = score >= self.floor[item]
        item, score, lost, doc_id = item[some], score[some], lost[some], doc_id[some]
        order = np.lexsort((doc_id, lost, -score, item))
        item, score, lost, doc_id = item[order], score[order], lost[order], doc_id[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else order
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        some = rank < self.k
        for i, s, x, d in zip(item[some].tolist(), score[some].tolist(), lost[some].tolist(), doc_id[some].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -x, -d))
            else:
                heapq.heappushpop(heap, (s, -x, -d))
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]

    def rows(self):
        for i, heap in enumerate(self.heaps):
            for s, x, d in heap:
                yield i, None if x else -d, s


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id, term and times of items (item_id, text)."""

    def run(batches):
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch["text"]]
            of = pa.array(np.repeat(np.arange(len(words)), list(map(len, words))))
            terms = pa.array([w for x in words for w in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["item"].take(of), terms], names=["item", "term"])

    named = stored(items.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    rows = texts.withColumnRenamed("item_id", "own_id").join(named, F.col("own_id").eqNullSafe(F.col("item_id")))
    terms = rows.select("item", "text").mapInArrow(run, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    return stored(terms.join(named, "item").select("item", "item_id", "term", "times"), "item-terms")


def blocks_of(terms: DataFrame, block_bytes: int, group_bytes: int) -> list[list[DataFrame]]:
    """Terms of items in as many blocks as it takes for none of several items to be over block_bytes, in groups of at most group_bytes or one block."""
    n_blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
        sizes = terms.groupBy(block.alias("block")).agg(F.sum(F.octet_length("term") + 24).cast("long").alias("n"), F.count_distinct("item").alias("items")).collect()
        if max((r["n"] for r in sizes if r["items"] > 1), default=0) <= block_bytes:
            groups, held = [], 0
            for r in sorted(sizes, key=lambda r: r["block"]):
                if not groups or held + r["n"] > group_bytes:
                    groups.append([])
                    held = 0
                groups[-1].append(terms.where(block == r["block"]))
                held += r["n"]
            return groups
        n_blocks = max(n_blocks + 1, -(-5 * sum(r["n"] for r in sizes) // (4 * block_bytes))) if n_blocks == 1 else 2 * n_blocks


def _matches(sent):
    """Documents (doc_id, text) to doc_id, the number of their terms, and the numbers and frequencies of those that items have."""

    def run(batches):
        number = {w: i for i, w in enumerate(sent.value)}
        for batch in batches:
            n, terms, often, ends = [], [np.empty(0, np.int32)], [np.empty(0, np.int32)], [0]
            for at in range(0, batch.num_rows, 256):  # a batch's texts never stand in memory twice
                for text in batch["text"].slice(at, 256).to_pylist():
                    words = words_of(text)
                    found = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    term, times = np.unique(found[found >= 0], return_counts=True)
                    n.append(len(words))
                    terms.append(term)
                    often.append(times.astype(np.int32))
                    ends.append(ends[-1] + len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (terms, often)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "often"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranked(sent, k: int):
    def run(batches):
        term, item, times, weights, n_docs, n_words, numbers = sent.value
        index = Index(term, item, times, len(weights))
        width = np.diff(index.start)
        best = Best(len(numbers), k)
        for batch in batches:
            ids = batch["doc_id"]
            lost, doc_id = np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy()
            m = 100 - LENGTH + LENGTH * batch["n"].to_numpy() * n_docs // n_words
            ends = batch["terms"].offsets.to_numpy()
            terms, often = batch["terms"].values.to_numpy(), batch["often"].values.to_numpy().astype(np.int64)
            # impacts up to each document, for cutting the batch
            upto = np.append(0, np.cumsum(width[terms]))[ends - ends[0]] if len(terms) else np.zeros(len(ends), dtype=np.int64)
            at = 0
            while at < len(ids):
                end = min(max(at + 1, int(np.searchsorted(upto, upto[at] + IMPACTS, side="right")) - 1), at + DOCUMENTS, len(ids))
                s = slice(ends[at], ends[end])
                doc = np.repeat(np.arange(end - at), np.diff(ends[at : end + 1]))
                tf = often[s]
                impact = weights[terms[s]] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at + doc]))
                found, where, score = index.accumulate(doc, terms[s], impact)
                best.offer(found, score, lost[at + where], doc_id[at + where])
                at = end
        rows = list(best.rows())
        i, d, s = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array([numbers[x] for x in i], pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(documents: DataFrame, items: DataFrame, *, k: int = 10, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents (doc_id, text) of each item (item_id, text) that score above 0."""
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = item_terms(items)
    found = []
    for group in blocks_of(every, block_bytes, group_bytes):
        known = group[0]
        for block in group[1:]:
            known = known.unionByName(block)
        words = sorted(r["term"] for r in known.select("term").distinct().collect())  # group_bytes at most
        number = {w: i for i, w in enumerate(words)}
        sent = context.broadcast([w.encode() for w in words])
        matches = stored(rows.mapInArrow(_matches(sent), "doc_id long, n long, terms array<int>, often array<int>"), "matches")
        sent.unpersist()
        n_docs, n_words = matches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = matches.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # the group's terms
        weights = np.zeros(len(words), dtype=np.int64)
        for r in counted:
            weights[r["term"]] = weight(n_docs, r["df"])
        for block in group if counted else []:
            held = block.select("item", "term", "times").orderBy("item", "term").toPandas()  # block_bytes at most
            numbers, item = np.unique(held["item"].to_numpy(), return_inverse=True)
            index = context.broadcast((held["term"].map(number).to_numpy(), item, held["times"].to_numpy(), weights, n_docs, n_words, numbers.tolist()))
            found.append(stored(matches.mapInArrow(_ranked(index, k), "item long, doc_id long, score long"), "best"))
            index.unpersist()
        drop_stored(matches)
    if not found:
        return every.select("item_id", F.lit(1).alias("rank"), F.col("item").alias("doc_id"), F.col("item").alias("score")).limit(0)
    best = found[0]
    for x in found[1:]:
        best = best.unionByName(x)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(every.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items scans each text once.

Texts are normalised to their words, and each word of the items is a fixed number of letters of the
automaton (the digits of its number), so a match's end tells the place of a word, which maps back to
the characters of the original.

The items are gathered by the driver in blocks of a checked size (BLOCK_BYTES), each sent to the executors
as a broadcast of that size at most. A benchmark within one block, the usual case, is one automaton and
one narrow pass. Of a larger one, each window has an anchor, the pair of neighbouring words with the
smallest hash, and the anchors of many blocks are sent out once (ANCHOR_ROWS): a pass over all texts
tells each the blocks that it holds anchors of, and only texts that hold some are written down and
scanned, by those blocks' automata, one after another. A task never holds more than one automaton and the
driver never more than one block, and all documents are read once for each ANCHOR_ROWS of anchors (some 40 MB of benchmark).

Defined cases: a null or empty text has no words and no hits; an item without words has no window;
equal windows of several items count for each; a null item_id counts as an occurring item named by
the empty string; repeated items count once; repeated document rows come back as often as they occur;
empty tables give no rows or no hits; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored, unused

#: Text of the benchmark items that one broadcast holds at most.
BLOCK_BYTES = 2 << 20
#: Words of an item that travel together; longer items are cut into pieces that overlap by a window but one word.
PIECE_WORDS = 4096

#: Anchors of blocks that one broadcast holds at most, 12 bytes each.
ANCHOR_ROWS = 1 << 20

#: ASCII bytes that are not part of words become spaces, and A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

FOUND = "n_words long, items array<string>, spans array<struct<start: long, end: long>>, char_spans array<struct<start: long, end: long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: Letters that each digit can be; no two digits of a word share one. Few, since a node's letters are searched one by one.
BASE = 64


class Automaton:
    """Over the windows of (item id, text) as strings of a few letters for each word; each window has its length and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import ahocorasick

        known = list(dict.fromkeys(w for _, text in items for w in words_of(text)))
        digits = self.digits = next(d for d in range(1, 9) if BASE**d >= len(known))
        self.letters = {w: "".join(chr(1 + BASE * d + number // BASE**d % BASE) for d in range(digits)) for number, w in enumerate(known)}
        self.other = "\0" * digits
        held: dict[str, list[str]] = {}
        for item, text in items:
            words = "".join(map(self.letters.__getitem__, words_of(text)))
            size = len(words) // digits
            for w in {words[i * digits : (i + n) * digits] for i in range(max(1, size - n + 1))} if words else ():
                if item not in held.setdefault(w, []):  # pieces of an item overlap
                    held[w].append(item)
        self.machine = ahocorasick.Automaton()
        for w, names in held.items():
            self.machine.add_word(w, (len(w) // digits, names))
        if held:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[np.ndarray, set[str]]:
        """A mark for each word of the text that a window covers, and the items found. Words that no item has are all alike."""
        words = words_of(text)
        hit, names = np.zeros(len(words) + 1, dtype=np.int32), set()
        if len(self.machine):
            for end, (size, items) in self.machine.iter("".join(map(self.letters.get, words, repeat(self.other)))):
                last = end // self.digits
                hit[last - size + 1] += 1
                hit[last + 1] -= 1
                names.update(items)
        return np.cumsum(hit[:-1]) > 0, names


_BUILT: dict = {}


def _automaton(block, n: int) -> Automaton:
    """The block's automaton, built once in each worker process, which holds no other."""
    key = (block.value[0], n)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(block.value[1], n)
    return _BUILT[key]


def _char_spans(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as spans of the original text's characters."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.append(0, np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in spans]


def merged(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _pieces(n: int):
    """Items to their words joined by spaces, long ones in overlapping pieces."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"], strict=True):
                words = words_of(text.as_py())
                # no piece begins behind the last whole window, or what is left would count as a short item of its own
                parts = [b" ".join(words[at : at + PIECE_WORDS + n - 1]) for at in range(0, max(1, len(words) - n + 1), PIECE_WORDS)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary()).cast(pa.string())], names=["item_id", "text"])

    return run


def blocks_of(benchmark: DataFrame, n: int, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items' pieces dealt to as many blocks as it takes for none to be over block_bytes; a piece itself is a few tens of kilobytes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(items.where("text is not null").distinct().mapInArrow(_pieces(n), "item_id string, text string"), "benchmark").withColumn("h", F.xxhash64("item_id", "text"))
    n_blocks = 1
    while True:
        sizes = pieces.groupBy(F.pmod("h", F.lit(n_blocks)).alias("block")).agg(F.sum(F.octet_length("text") + 16).cast("long").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        # a block that is one piece can't be dealt more finely
        over = max((r["n"] for r in sizes if r["rows"] > 1), default=0)
        if over <= block_bytes:
            return [pieces.where(F.pmod("h", F.lit(n_blocks)) == i).select("item_id", "text") for i in range(n_blocks)]
        n_blocks = max(n_blocks + 1, -(-5 * sum(r["n"] for r in sizes) // (4 * block_bytes))) if n_blocks == 1 else 2 * n_blocks


def _broadcast(block: DataFrame):
    rows = [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]
    return block.sparkSession.sparkContext.broadcast((f"{hash(tuple(rows))}-{len(rows)}", rows))


def _few(texts: pa.Array, rows: int = 256):
    """The texts of a batch, a few at a time, so that a batch never stands in memory twice."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


def _finder(block, n: int, with_chars: bool) -> Callable[[Column], Column]:
    """A column function of text: FOUND, char_spans empty unless asked for."""

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            machine = _automaton(block, n)
            out = []
            for t in _few(texts):
                hit, names = machine.scan(t)
                spans = merged(hit)
                out.append((len(hit), sorted(names), spans, _char_spans(t, spans) if spans and with_chars else []))
            yield _found(out)
        release()

    return find


def _found(rows: list[tuple[int, list[str], list[tuple[int, int]], list[dict]]]) -> pa.StructArray:
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], _SPANS), pa.array([r[3] for r in rows], _SPANS),
    ]
    return pa.StructArray.from_arrays(columns, names=["n_words", "items", "spans", "char_spans"])


def _together(texts: pa.Array, n_words: pa.Array, items: pa.Array, spans: pa.Array) -> pa.Array:
    """The hits of several blocks in one text: items sorted, spans merged. Texts without hits need not be there."""
    out = []
    for text, n, names, found in zip(texts, n_words.to_pylist(), items, spans, strict=True):
        names = names.as_py()
        if not names:
            out.append((n, [], [], []))
            continue
        hit = np.zeros(n, dtype=bool)
        for s in found.as_py():
            hit[s["start"] : s["end"]] = True
        covered = merged(hit)
        out.append((n, sorted(set(names)), covered, _char_spans(text.as_py(), covered)))
    return _found(out)


class Pairs:
    """Hashes of neighbouring words, and of a word that is alone, the same in every process."""

    ONE, TWO, LONE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def _words(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of neighbours, and of each word."""
        h = self._words(words)
        both = h[:-1] * self.ONE + (h[1:] ^ (h[1:] >> np.uint64(29))) * self.TWO
        return both ^ (both >> np.uint64(32)), h * self.LONE


def _anchors(n: int):
    """Pieces (block, text) to the anchors of their windows: of each window the smallest hash of its pairs, or of its only word."""

    def run(batches):
        pairs = Pairs()
        for batch in batches:
            blocks, found = [], [np.empty(0, np.uint64)]
            for block, text in zip(batch["block"].to_pylist(), batch["text"], strict=True):
                words = words_of(text.as_py())
                both, lone = pairs(words)
                size = min(n, len(words)) - 1
                mine = np.unique(np.lib.stride_tricks.sliding_window_view(both, size).min(axis=1)) if size > 0 else np.unique(lone)
                found.append(mine)
                blocks += [block] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(np.concatenate(found).view(np.int64))], names=["block", "anchor"])

    return run


def _routed(sent):
    """Rows (row, doc_id, text) to their number of words, the blocks that they hold anchors of, and the text if there are any."""

    def run(batches):
        hashes, starts, blocks = sent.value
        pairs = Pairs()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, n, lists = part["text"].to_pylist(), [], []
                for text in texts:
                    words = words_of(text)
                    n.append(len(words))
                    every = np.concatenate(pairs(words))
                    place = np.minimum(np.searchsorted(hashes, every), max(0, len(hashes) - 1))
                    there = np.unique(place[hashes[place] == every]) if len(hashes) else place[:0]
                    lists.append(sorted({b for k in there.tolist() for b in blocks[starts[k] : starts[k + 1]].tolist()}))
                kept = [t if b else None for t, b in zip(texts, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["row", "doc_id", "n_words", "blocks", "text"])
        release()

    return run


def _groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Blocks (number, anchors) in groups of at most so many anchors, or of one block."""
    out, held = [], 0
    for block, n in sizes:
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(block)
        held += n
    return out


def _hits(rows: DataFrame, blocks: list[DataFrame], n: int, anchor_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, doc_id, text): row, doc_id, n_words and, where it may be needed, text; and the hits (row, items, spans) of all blocks."""
    pieces = blocks[0].withColumn("block", F.lit(0))
    for number, block in enumerate(blocks[1:], 1):
        pieces = pieces.unionByName(block.withColumn("block", F.lit(number)))
    anchors = stored(pieces.select("block", "text").mapInArrow(_anchors(n), "block int, anchor long").distinct(), "anchors")
    sizes = [(r["block"], r["n"]) for r in anchors.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()]
    routed, hits = [], []
    for group in _groups(sizes, anchor_rows):
        held = anchors.where(F.col("block").isin(group)).toPandas()  # anchor_rows at most, or one block's
        order = np.argsort(held["anchor"].to_numpy().view(np.uint64), kind="stable")
        every, starts = np.unique(held["anchor"].to_numpy().view(np.uint64)[order], return_index=True)
        sent = rows.sparkSession.sparkContext.broadcast((every, np.append(starts, len(order)), held["block"].to_numpy()[order]))
        found = stored(rows.mapInArrow(_routed(sent), "row long, doc_id long, n_words long, blocks array<int>, text string"), "routed")
        sent.unpersist()
        routed.append(found)
        for number in group:
            sent = _broadcast(blocks[number])
            texts = found.where(F.array_contains("blocks", number)).select("row", "text")
            hit = texts.select("row", _finder(sent, n, False)(F.col("text")).alias("found")).where(F.size("found.items") > 0)
            hits.append(stored(hit.select("row", "found.items", "found.spans"), "hits"))
            sent.unpersist()
    every = hits[0]
    for x in hits[1:]:
        every = every.unionByName(x)
    every = every.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    whole = routed[0].drop("blocks")
    for number, x in enumerate(routed[1:]):
        whole = whole.join(x.select("row", F.col("text").alias(f"text{number}")), "row").withColumn("text", F.coalesce("text", f"text{number}")).drop(f"text{number}")
    return whole, every


def scan(documents: DataFrame, benchmark: DataFrame, *, n: int = 10, block_bytes: int = BLOCK_BYTES, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """For each document: n_words, the items with a window in it (sorted), and the hit spans, in words and in characters (ends excluded)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks_of(benchmark, n, block_bytes)
    if len(blocks) == 1:
        return rows.select("doc_id", _finder(_broadcast(blocks[0]), n, True)(F.col("text")).alias("found")).select("doc_id", "found.*")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered").select("row", "doc_id", "text")
    whole, every = _hits(rows, blocks, n, anchor_rows)
    found = F.arrow_udf(_together, FOUND)(F.col("text"), F.col("n_words"), F.col("items"), F.col("spans"))
    return whole.join(every, "row", "left").select("doc_id", found.alias("found")).select("doc_id", "found.*")


def _cleaner(block, n: int) -> Callable[[Column], Column]:
    """A column function of text: whether no window of the block is in it."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            machine = _automaton(block, n)
            yield pa.array([not machine.scan(t)[0].any() for t in _few(texts)], pa.bool_())
        release()

    return clean


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, n: int = 10, block_bytes: int = BLOCK_BYTES, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """The rows of documents, with all their columns, whose text holds no window of any item."""
    blocks = blocks_of(benchmark, n, block_bytes)
    if len(blocks) == 1:
        return documents.where(_cleaner(_broadcast(blocks[0]), n)(F.col("text").cast("string")))
    row = unused("row", *documents.columns)
    rows = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, hits = _hits(rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), blocks, n, anchor_rows)
    return rows.join(hits.select(F.col("row").alias(row)), row, "left_anti").drop(row)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes, so two that differ in at most 4 bits share at least 4 bytes in place.
Of any 4 positions, 3 form one of the 20 triples below, so every such pair meets in a posting list
keyed by a triple of positional bytes. Of pairs that meet, the bytes shared in place are tallied over
all positions; those with fewer than the guaranteed 4 fall, and the rest is verified bit by bit. This
holds in lists of any length.

Copies share a fingerprint and enter the index once. Posting lists of up to LIGHT fingerprints are
joined; longer ones are dealt to pairs of blocks, each of which returns a spanning forest of its
links. Components come from alternating stars over written tables; no list of links, components or
fingerprints leaves the executors.

Defined cases: a null text has no words; a text without words has fingerprint zero, linked like any
other; a null doc_id is kept and never names a component unless all its members are null; repeated
rows come back as often as they occur; an empty table gives no rows; other columns are not used.

near_copies() and keep_one() take the links of fingerprints as candidates, and check each by the
similarity of shingle sets. A pair can reach the similarity with fingerprints further apart; those are
met in bands of minima of the shingles' hashes, and checked likewise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, release, stored, unused

N_BYTES = 8
#: Posting lists up to this long are joined row by row.
LIGHT = 64
#: Fingerprints in a block of a long posting list.
BLOCK = 2048
#: Shingle sets on each side of a block of a long list of near copies.
SETS = 512
#: Minima in the key of a band of near_copies().
BAND = 5
#: Probability with which a pair of exactly the asked similarity may meet in no band.
MISSED = 1e-6
#: An odd multiplier (fixed value).
MIX = np.uint64(0x9E3779B97F4A7C15)


def _triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any 4 positions hold one: with groups a, b, c of positions, those in one group, or two in a group and one in the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [(*two, one) for i, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in inside + across]


TRIPLES = _triples()


def fingerprint(text: str | None, n_words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats counted: a bit is set if it is set in over half of the XXH64 values."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[n_words - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, n_words: int = 4, seed: int = 42) -> Column:
    """A signed long with the fingerprint's 64 bits."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), n_words, seed) for t in texts], dtype=np.uint64).view(np.int64))
        release()

    return fp(text.cast("string"))


def fingerprints(documents: DataFrame, n_words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp of each row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text"), n_words, seed).alias("fp"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftright(fp, 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """A row for each distinct fingerprint and triple: key (number of the triple and its three bytes) and fp."""
    keys = [F.lit(n << 24) + _byte(F.col("fp"), i) * 65536 + _byte(F.col("fp"), j) * 256 + _byte(F.col("fp"), k) for n, (i, j, k) in enumerate(TRIPLES)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _tally(a: Column, b: Column) -> Column:
    """How many bytes two fingerprints share in place."""
    return reduce(lambda x, y: x + y, [(_byte(a, i) == _byte(b, i)).cast("int") for i in range(N_BYTES)])


def _forest(max_bits: int):
    def links(table: pa.Table) -> pa.Table:
        """Of one pair of blocks: each fingerprint linked to the smallest that it reaches inside the pair."""
        fps = np.unique(table["fp"].to_numpy())
        by_place = np.ascontiguousarray(fps.astype("<i8").view(np.uint8).reshape(-1, N_BYTES).T)
        near = np.zeros((len(fps), len(fps)), dtype=bool)
        for i, fp in enumerate(fps):
            tally = (by_place == by_place[:, i : i + 1]).sum(axis=0, dtype=np.uint8)
            met = np.flatnonzero(tally >= N_BYTES - max_bits)
            near[i, met] = np.bitwise_count(fps[met] ^ fp) <= max_bits
        label, before = np.arange(len(fps)), None
        while before is None or (label != before).any():
            before = label
            label = np.array([label[row].min() for row in near])
            label = label[label]
        moved = label != np.arange(len(fps))
        return pa.table({"a": pa.array(fps[moved]), "b": pa.array(fps[label[moved]])})

    return links


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all those within max_bits, 4 at most.

    Short posting lists give every link they hold, long ones a spanning forest of theirs.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the byte index guarantees links of at most 4 bits")
    postings = _postings(fps)
    heavy = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIGHT), "heavy-keys")
    light = postings.join(heavy.select("key"), "key", "left_anti")
    a, b = light.select("key", F.col("fp").alias("a")), light.select("key", F.col("fp").alias("b"))
    tallied = a.join(b, "key").where("a < b").withColumn("tally", _tally(F.col("a"), F.col("b"))).where(F.col("tally") >= N_BYTES - max_bits)
    pairs = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()

    rows = postings.join(heavy, "key")
    n_blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    forest = rows.groupBy("key", "i", "j").applyInArrow(_forest(max_bits), "a long, b long")
    return pairs.unionByName(forest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For each node of edges (a, b): node and root, the smallest node it reaches. Alternating large and small stars."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        read = [edges]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        read.append(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        edges = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        read += [large, least]
        edges = stored(edges, "small-star")
        drop_stored(*read)  # what this round was made of
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _classes(docs: DataFrame, max_bits: int) -> DataFrame:
    """Of the stored fingerprints of documents: fp, first_id (its smallest doc_id) and root (its component) of each distinct fingerprint."""
    members = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "members")
    roots = components(links(members.select("fp"), max_bits))
    return stored(members.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(documents: DataFrame, *, n_words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for each row of documents."""
    docs = stored(fingerprints(documents, n_words, seed), "fingerprints")
    rooted = _classes(docs, max_bits)
    names = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    classes = stored(rooted.join(names, "root").select("fp", "component_id"), "classes")
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


class _Words(dict):
    """Row of each word in the table of its hashes."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros(1 << 14, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n


def _content(text: str | None) -> tuple[int, list[bytes]]:
    """A hash of the lower-cased words, and the words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)), words


def shingle_set(words: list[bytes], n_words: int, known: _Words | None = None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; all words of a shorter text are one."""
    if not words:
        return np.empty(0, dtype="<u8")
    known = _Words() if known is None else known
    rows = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    hashes, width = known.table[rows], min(n_words, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * MIX + hashes[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out * MIX).astype("<u8")


def _bands(similarity: float) -> int:
    """How many bands leave a pair of that similarity unmet with a probability of at most MISSED."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**BAND)))


def band_keys(shingles: np.ndarray, n_bands: int) -> np.ndarray:
    """A key for each band: of its number and of the minima of the shingles under its BAND hash functions."""
    if not len(shingles):
        return np.empty(0, dtype=np.int64)
    drawn = np.random.default_rng(20).integers(0, 1 << 32, size=(2, n_bands * BAND, 1), dtype=np.uint32)
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(n_bands * BAND, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (x[at : at + 512] * (drawn[0] | np.uint32(1)) + drawn[1]).min(axis=1))
    least = least.reshape(n_bands, BAND).astype(np.uint64)
    keys = np.arange(1, n_bands + 1, dtype=np.uint64) * MIX
    for i in range(BAND):
        keys = (keys ^ least[:, i]) * MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets' intersection is at least that share of their union."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    shared = np.intersect1d(x, y, assume_unique=True).size
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def _alike(similarity: float):
    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), similarity) for x, y in zip(a, b, strict=True)], pa.bool_())
        a = b = None
        release()

    return alike


def _across(similarity: float):
    def links(table: pa.Table) -> pa.Table:
        """Of a block of a list's others and a block of all its texts: links that join the components between which there is any."""
        c, root, other = (table[n].to_numpy() for n in ("c", "root", "other"))
        sets = [np.frombuffer(x.as_py(), "<u8") for x in table["s"]]
        sizes, label = np.array([len(s) for s in sets]), root.copy()
        whole, out = np.flatnonzero(~other), []
        for i in np.flatnonzero(other):
            fits = np.minimum(sizes[whole], sizes[i]) >= similarity * np.maximum(sizes[whole], sizes[i]) - 1e-9
            for j in whole[fits & (root[whole] != root[i])]:
                if label[i] != label[j] and similar(sets[i], sets[j], similarity):
                    out.append((c[i], c[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def near_copies(documents: DataFrame, *, n_words: int = 5, similarity: float = 0.8, max_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Near copies of any size of text: (documents' doc_id and c, the hash of their words; c and root of each distinct text).

    Two texts are linked if the similarity of their shingle sets is reached, and only then. Candidates
    are texts whose fingerprints are linked in the index (links()), and, for pairs with more than max_bits
    differing bits, texts that share the minima of their shingles under the hash functions of a band; of a pair that
    reaches the similarity, at most one in 1 / MISSED meets in none. Each list of candidates proposes
    links to its first text. Where the verified ones leave a list in several components, the texts
    outside its largest are held against all others of the list: pair by pair up to LIGHT texts,
    in longer lists block by block. All links are verified by the shingle sets, whatever the list's length.
    """
    n_bands = _bands(similarity)

    @F.arrow_udf("struct<c: long, fp: long, keys: array<long>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words()
        for texts in batches:
            contents, fps, keys = [], [], []
            for t in texts:
                content, words = _content(t.as_py())
                known = _Words() if len(known) > 150_000 else known
                contents.append(content)
                fps.append(fingerprint(t.as_py(), n_words))
                keys.append(band_keys(shingle_set(words, n_words, known), n_bands))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, dtype=np.int64)])))
            yield pa.StructArray.from_arrays([*[pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (contents, fps)], lists], names=["c", "fp", "keys"])
        known = texts = lists = None
        release()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), look(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")
    docs = stored(docs, "looks")
    nodes = stored(docs.groupBy("c").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("doc_id").alias("first_id")), "texts")  # equal texts have equal fingerprints and keys

    # fingerprints stand for their first text: their other texts, and the texts of linked fingerprints, are candidates
    of_fp = stored(nodes.groupBy("fp").agg(F.min("c").alias("of")), "fingerprints")
    near = links(of_fp.select("fp"), max_bits).join(of_fp.select(F.col("fp").alias("a"), F.col("of").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("of").alias("y")), "b")
    alike = nodes.join(of_fp, "fp").where("c <> of").select(F.col("c").alias("x"), F.col("of").alias("y"))
    proposed = stored(near.select("x", "y").unionByName(alike).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "proposed")

    postings = nodes.select("c", F.explode("keys").alias("key"))
    lists = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).where("n > 1"), "lists")
    postings = stored(postings.join(lists, "key"), "postings")

    @F.arrow_udf("struct<c: long, s: binary>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words()
        for texts in batches:
            contents, sets = [], []
            for t in texts:
                content, words = _content(t.as_py())
                known = _Words() if len(known) > 150_000 else known
                contents.append(content)
                sets.append(shingle_set(words, n_words, known).tobytes())
            yield pa.StructArray.from_arrays([pa.array(np.array(contents, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["c", "s"])
        known = texts = sets = None
        release()

    wanted = postings.select("c").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("c"))).distinct()
    first = nodes.join(wanted, "c", "left_semi").select("first_id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(first, F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = stored(texts.select(shingles(F.col("text")).alias("x")).select("x.c", "x.s").dropDuplicates(["c"]), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
        return pairs.where(_alike(similarity)(F.col("sa"), F.col("sb"))).select("a", "b")

    first = postings.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b"))
    roots = components(verified(first.unionByName(proposed).distinct()))

    members = postings.where("n > 2").select("key", "c").join(roots, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    members = stored(members, "members")
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    several = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("x")).where("n > x.m")
    members = stored(members.join(several.select("key", "n", F.col("x.root").alias("largest"), (F.col("n") - F.col("x.m")).alias("n_others")), "key"), "open-lists")
    if members.isEmpty():
        return docs.select("doc_id", "c"), _rooted(nodes, roots)

    light = members.where(F.col("n") <= LIGHT)
    a = light.where("root <> largest").select("key", F.col("c").alias("a"), F.col("root").alias("ra"))
    b = light.select("key", F.col("c").alias("b"), F.col("root").alias("rb"))
    pairs = a.join(b, "key").where("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    heavy = members.where(F.col("n") > LIGHT)
    i, j = (F.ceil(F.col(n) / F.lit(SETS)).cast("int") for n in ("n_others", "n"))
    dealt, every = lambda n: F.pmod(F.xxhash64("c"), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    others = heavy.where("root <> largest").select("key", dealt(i).alias("i"), every(j).alias("j"), "c", "root", F.lit(True).alias("other"))
    whole = heavy.select("key", every(i).alias("i"), dealt(j).alias("j"), "c", "root", F.lit(False).alias("other"))
    found = others.unionByName(whole).join(sets, "c").groupBy("key", "i", "j").applyInArrow(_across(similarity), "a long, b long")
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(pairs)).unionByName(found)
    return docs.select("doc_id", "c"), _rooted(nodes, components(edges))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return stored(nodes.select("c").join(roots, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root")), "rooted")


def keep_one(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of documents, with all their columns, that stand for their group of near_copies(): the one with the smallest doc_id (a null id only if there is no other); of rows with its id and text, the one with the smallest hash of all columns."""
    docs, rooted = near_copies(documents, **parameters)
    members = docs.groupBy("c").agg(F.min("doc_id").alias("first_id")).join(rooted, "c")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "c")).alias("x")
    kept = stored(members.groupBy("root").agg(first).select(F.col("x.c").alias("kept_c"), F.col("x.first_id").alias("kept_id")), "kept")

    @F.arrow_udf("long")
    def content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([_content(t.as_py())[0] for t in texts], dtype="<u8").view(np.int64))
        release()

    columns = documents.columns
    own_c, one = unused("own_c", *columns), unused("of_equal_rows", *columns)
    kept = kept.withColumnsRenamed({"kept_c": unused("kept_c", *columns), "kept_id": unused("kept_id", *columns)})
    rows = documents.withColumn(own_c, content(F.col("text").cast("string")))
    same = [F.col(own_c) == F.col(kept.columns[0]), F.col("doc_id").cast("long").eqNullSafe(F.col(kept.columns[1]))]
    rows = rows.join(kept, same, "left_semi")
    if docs.groupBy("doc_id", "c").count().where("count > 1").isEmpty():
        return rows.select(*columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    first = rows.groupBy(F.col("doc_id").cast("long").alias("k"), F.col(own_c).alias("c")).agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in columns if not _unhashed(documents.schema[c].dataType)])).alias(one))
    return first.select(f"{one}.*")


def _unhashed(kind) -> bool:
    """Maps, which have no hash."""
    return "map<" in kind.simpleString()

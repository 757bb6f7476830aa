"""Exact top-k inner products by a three-phase uniform threshold.

A vector's coordinates are cut into slices; a score is the sum of its slices' partial scores, and each
slice of a block of queries and a block of candidates gives local lists of partial scores.

1. Each list gives its heads. Those of a pair of blocks are scored exactly, and the task keeps of each
   query the best k + 1 over all candidate blocks it reads. The (k + 1)-th best over all tasks is a
   cutoff that no answer falls below.
2. Each query's cutoff goes out with its block. A vector that reaches the cutoff has a partial score
   of at least cutoff / slices in some slice, so the entries that reach that are sufficient.
3. Entries that came from every slice are complete; the rest is resolved exactly by the task, which
   holds all slices of both blocks. It gives, of those at or above the cutoff, the best k + 1 of each
   query, and the best k of all tasks remain.

So rows that leave tasks follow the queries and the tasks, never the pairs. The products of blocks are
made twice, since to keep them would cost a number for each pair.

Equal vectors form one class that is scored once and carries its smallest distinct ids, k + 1 at
most and each at most k times, which are all that an answer can name: one more than k because a
query's own rows do not count. Classes that hold nothing but a query's own id are left out before any
list or cutoff is cut. Queries, cutoffs and lists are tables in blocks; none is held by the driver.

Defined cases: a null or empty vector, one with a null or non-finite component, or one with a null
id takes no part; shorter vectors count as padded with zeros; rows with the query's id are its own;
the rows of a repeated query id share one list of k, in which each names its answers, and a repeated
candidate row counts as often as it occurs; ties go to the smaller id; with fewer than k candidates all are returned; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

FOUND = "q long, c long, score long, least long"
#: Queries of a block that are multiplied at once, and query blocks whose lists a task holds before it gives them out.
ROWS, HELD = 256, 256
FIRST = np.iinfo(np.int64).min


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and v, the floors of the scaled components as longs, of the vectors that take part."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & (F.size("e") > 0)).where(finite)
    return vectors.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(scale))).alias("v"))


def _pack(names: list[str]):
    """A block's rows to one row: its dimension, each of the named numbers, and the matrix, as bytes."""

    def run(key, table):
        lists = table["v"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        dim = int(lengths.max())
        full = np.zeros((len(lists), dim), dtype=np.int64)
        full[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(full).max(initial=0) <= np.iinfo(t).max)
        row = {"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "kind": pa.array([np.dtype(kind).str])}
        row |= {n: pa.array([table[n].to_numpy().astype(np.int64).tobytes()], pa.binary()) for n in names}
        return pa.table(row | {"m": pa.array([full.astype(kind).tobytes()], pa.binary())})

    return run


def _blocks(vectors: DataFrame, n_blocks: int, names: list[str], prefix: str = "") -> DataFrame:
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int")).select("block", *names, "v")
    packed = dealt.groupBy("block").applyInArrow(_pack(names), "block int, dim int, kind string, " + "".join(f"{n} binary, " for n in names) + "m binary")
    return packed.toDF(*[prefix + c for c in packed.columns])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact: in doubles while no sum can leave their whole numbers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _heads(n: int, slices: int):
    def pick(parts: list[np.ndarray], cutoff: np.ndarray) -> np.ndarray:
        """Which entries stand at the head of any slice's list."""
        out = np.zeros(parts[0].shape, dtype=bool)
        here = min(n, out.shape[1])
        for p in parts:
            np.put_along_axis(out, np.argpartition(p, out.shape[1] - here, axis=1)[:, out.shape[1] - here :], True, axis=1)
        return out

    return pick


def _reach(n: int, slices: int):
    def pick(parts: list[np.ndarray], cutoff: np.ndarray) -> np.ndarray:
        """Which entries are sufficient in any slice, and reach the cutoff once the other slices resolve them."""
        sufficient = np.zeros(parts[0].shape, dtype=bool)
        for p in parts:
            sufficient |= p >= -(-cutoff // slices)[:, None]
        i, j = np.nonzero(sufficient)
        fails = sum(p[i, j] for p in parts) < cutoff[i]
        sufficient[i[fails], j[fails]] = False
        return sufficient

    return pick


def _best(q: np.ndarray, c: np.ndarray, score: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each query the best entries by score and least id."""
    order = np.lexsort((c, least, -score, q))
    q, c, score, least = q[order], c[order], score[order], least[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return tuple(x[rank < most] for x in (q, c, score, least))


def _lists(pick, slices: int, most: int):
    """Over pairs of blocks: the best entries of each query among those that pick chooses, without classes of the query's own id alone."""

    def of(row: dict) -> tuple[np.ndarray, ...]:
        cls, one, two, lone = (np.frombuffer(row[n], np.int64) for n in ("cls", "one", "two", "lone"))
        q, own, apart, cutoff = (np.frombuffer(row[n], np.int64) for n in ("q_cls", "q_own", "q_apart", "q_cutoff"))
        a, b = np.frombuffer(row["q_m"], row["q_kind"]).reshape(len(q), -1), np.frombuffer(row["m"], row["kind"]).reshape(len(cls), -1)
        shared, out = min(a.shape[1], b.shape[1]), []
        for at in range(0, len(q), ROWS):
            rows = slice(at, at + ROWS)
            parts = [products(a[rows, s:shared:slices], b[:, s:shared:slices]) for s in range(slices)]
            mine = (own[rows, None] == one) & (apart[rows, None] == 1)
            sole = mine & (lone == 1)
            for p in parts:
                p[sole] = FIRST // (2 * slices)
            i, j = np.nonzero(pick(parts, cutoff[rows]) & ~sole)
            least = np.where(mine[i, j], two[j], one[j])
            out.append(_best(q[rows][i], cls[j], sum(p[i, j] for p in parts), least, most))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def run(batches):
        held: dict[int, tuple[np.ndarray, ...]] = {}

        def given():
            for x in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in x], names=["q", "c", "score", "least"])
            held.clear()

        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch[name][n].as_py() for name in batch.schema.names}
                new, before = of(row), held.get(row["q_block"])
                held[row["q_block"]] = new if before is None else _best(*map(np.concatenate, zip(before, new, strict=True)), most)
                if len(held) > HELD:
                    yield from given()
        yield from given()

    return run


def _search(queries: DataFrame, candidates: DataFrame, n_blocks: int, n_query_blocks: int, pick, slices: int, most: int) -> DataFrame:
    """Every block of queries beside every block of candidates."""
    q = _blocks(queries, n_query_blocks, ["cls", "own", "apart", "cutoff"], "q_").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return candidates.join(q, "block").mapInArrow(_lists(pick, slices, most), FOUND)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, slices: int = 2, query_block: int = 2048, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of each query id of vectors (vec_id, v)."""
    most = k + 1
    counts = vectors.select("vec_id", "v", is_query.alias("is_query")).groupBy("v", "vec_id")
    counts = stored(counts.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("asked")), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = counts.select("v", "vec_id", F.least("n", F.lit(k)).cast("int").alias("n")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= most)
    classes = ids.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("x"))
    classes = classes.select("v", F.flatten(F.transform("x", lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"), F.when(F.size("x") == 1, F.col("x")[0]["vec_id"]).alias("sole_id"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    # query ids that have a class for themselves, or more than one: these are told apart, others share the query of their vector
    places = counts.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("asked").alias("asked")).where("asked > 0")
    alone = classes.where("sole_id is not null").select(F.col("sole_id").alias("vec_id")).distinct().withColumn("alone", F.lit(True))
    owners = places.join(alone, "vec_id", "left").where("n > 1 OR alone").select(F.col("vec_id").alias("own_id"))
    owners = stored(owners, "owners")
    second = F.get(F.filter("ids", lambda x: x != F.col("one")), F.lit(0))
    classes = classes.withColumn("one", F.get("ids", F.lit(0))).withColumns({"two": F.coalesce(second, F.lit(0)), "lone": second.isNull().cast("long")})
    asked = counts.where("asked > 0").join(owners, F.col("vec_id") == F.col("own_id"), "left")
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "asked", F.coalesce("own_id", F.lit(0)).alias("own"), F.col("own_id").isNotNull().cast("long").alias("apart"))
    asked = stored(asked, "asked")
    queries = stored(asked.select("v", "own", "apart").distinct().withColumn("cls", F.monotonically_increasing_id()), "queries")

    n_blocks, n_query_blocks = parts_for(classes.count(), block), parts_for(queries.count(), query_block)
    candidates = stored(_blocks(classes, n_blocks, ["cls", "one", "two", "lone"]), "candidate-blocks")
    far = int(FIRST // 4)
    heads = _search(queries.withColumn("cutoff", F.lit(far)), candidates, n_blocks, n_query_blocks, _heads(most, slices), slices, most)
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    cutoffs = heads.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == most).select(F.col("q").alias("cls"), F.col("score").alias("cutoff"))
    cutoffs = stored(cutoffs, "cutoffs")

    bounded = queries.join(cutoffs, "cls", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(far)))
    found = _search(bounded, candidates, n_blocks, n_query_blocks, _reach(most, slices), slices, most)
    lists = stored(found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= most), "found")
    lists = lists.join(classes.select(F.col("cls").alias("c"), "ids"), "c")
    lists = lists.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found")).join(queries.select(F.col("cls").alias("q"), "v", "own", "apart"), "q").select("v", "own", "apart", "found")
    lists = stored(lists, "lists")

    entry = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("minus"), i.alias("vec_id")))))
    others = F.filter(entry, lambda x: x["vec_id"] != F.col("query_id"))
    answers = asked.join(lists, ["v", "own", "apart"]).select("query_id", "asked", F.explode(F.slice(F.array_sort(others), 1, k)).alias("x"))
    answers = answers.select("query_id", "x", F.explode(F.array_repeat(F.lit(0), F.least("asked", F.lit(k)).cast("int"))))
    by_rank = Window.partitionBy("query_id").orderBy("x.minus", "x.vec_id")
    answers = answers.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))

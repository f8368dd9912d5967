"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is coded as the sum of one codeword from each of CODEBOOKS full-dimensional codebooks,
trained on the residuals of a bounded sample; encoding searches with a beam, and the squared norm
of the sum is stored beside the codes (it orders the beam, and turns the scores into distances
where those are asked for). A query's table of inner products with all codewords scores a code by
lookups. The best candidates by those scores are then ranked by exact inner products in double
precision. By Cauchy and Schwarz a table score errs by at most the query's norm times the norm of
what the codes leave of the vector, which is stored too: where that allows a vector beyond the
candidates to be among the nearest, the query is answered by an exact scan of all vectors in blocks.
So results are the true nearest, and the codes only save work. Equal vectors are coded once, so a
vector that very many rows hold crowds nothing out: searches find distinct vectors, and each stands
for its rows with the smallest ids. Edge cases:

* vectors that are null, empty, zero, or hold a null or a non-finite number take no part, nor do
  vectors of another length than most or rows with a null vec_id;
* repeated rows with one vec_id and vector are one; ties go to the smaller vec_id; with fewer than
  k candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, skew_join

CODEBOOKS = 32
CODEWORDS = 256
BEAM = 4

#: Codebooks are fitted on at most this many distinct vectors (the lowest hashes); all are encoded.
SAMPLE = 8192

#: Distinct vectors that a query's table scores keep for the exact ranking; it decides which queries
#: need the exact scan, not what is found.
RERANK = 256

#: Vectors of a block of codes, and queries of a block of queries.
CODE_BLOCK = 16384
QUERY_BLOCK = 512


@dataclass
class Quantiser:
    """books: CODEBOOKS x codewords x dimensions."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the decoded vectors), keeping the `beam` best partial sums at every codebook."""
        m, k, _ = self.books.shape
        n = len(x)
        codes, sums = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, x.shape[1]), np.float32)
        for book in self.books:
            rest = x[:, None, :] - sums
            # |rest - word|^2 without the word's own part of the beam's norm
            cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            row, word = best // k, best % k
            sums = np.take_along_axis(sums, row[:, :, None], 1) + book[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        best = ((x[:, None, :] - sums) ** 2).sum(2).argmin(1)
        found = sums[np.arange(n), best]
        return codes[np.arange(n), best], (found * found).sum(1)

    def left(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The norm of what the codes leave of each vector, in double precision, rounded up."""
        rest = x.astype(np.float64)
        for m, book in enumerate(self.books):
            rest = rest - book[codes[:, m]]
        return np.sqrt((rest * rest).sum(1)) * (1 + 1e-12)

    def rounding(self) -> float:
        """How far a table score of a query of norm 1 may be off by single precision alone."""
        longest = np.sqrt((self.books.astype(np.float64) ** 2).sum(2).max(1)).sum()
        return float(2 * (sum(self.books.shape[::2]) + 4) * np.finfo(np.float32).eps * longest)


def train(sample: np.ndarray, rounds: int = 6, seed: int = 3) -> Quantiser:
    """k-means on the residuals of one codebook after another."""
    rng = np.random.default_rng(seed)
    rest, books = sample.astype(np.float32).copy(), []
    for _ in range(CODEBOOKS):
        k = min(CODEWORDS, len(rest))
        book = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = (-2 * rest @ book.T + (book * book).sum(1)).argmin(1)
            count = np.bincount(near, minlength=k)
            order, heads = np.argsort(near, kind="stable"), np.concatenate([[0], np.cumsum(count)[:-1]])
            sums = np.concatenate([np.zeros((1, rest.shape[1])), np.cumsum(rest[order], axis=0, dtype=np.float64)])
            total = sums[heads + count] - sums[heads]
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
        near = (-2 * rest @ book.T + (book * book).sum(1)).argmin(1)
        rest = rest - book[near]
        books.append(book)
    return Quantiser(np.stack(books))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """vec_id (long), v (as it is given), key of every row that takes part; key is equal for equal vectors."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    # exists() is null where a null decides: coalesce takes such vectors out
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.where(sound)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    text = F.array_join(F.transform("v", lambda x: (x.cast("double") + 0.0).cast("string")), ",")
    return rows.withColumn("key", F.unhex(F.md5(text)))


def _blocks(batches, size: int):
    """Tables of `size` rows each, the last one of fewer."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            held.append(batch.slice(0, size - n))
            batch = batch.slice(size - n)
            n += len(held[-1])
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _query_blocks(batches):
    for t in _blocks(batches, QUERY_BLOCK):
        yield pa.RecordBatch.from_pydict({"queries": pa.array([t["vec_id"].to_numpy().tobytes()], pa.binary()), "q": pa.array([_matrix(t["v"].combine_chunks()).astype(np.float64).tobytes()], pa.binary())})


def _meet(left: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of left beside every block of queries: block, queries, q and the columns of left."""
    right = cut(asked.mapInArrow(_query_blocks, "queries binary, q binary").withColumn("id", F.monotonically_increasing_id()))
    # ids hold the number of a task and a number in it: a row a task makes them gapless, so blocks need no list
    tasks = right.groupBy(F.shiftright("id", 33).alias("task")).agg(F.count("*").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("before"))
    right = right.withColumn("task", F.shiftright("id", 33)).join(F.broadcast(tasks), "task")
    right = right.select((F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("block"), "queries", "q")
    number = right.count()
    met = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))) if number else F.lit(-1).cast("long"))
    met = met.join(right, "block").select("block", "queries", "q", *left.columns)
    # dealt by a hash of the block, not the join's own key: an exchange that the planner keeps, and
    # that no split of a skewed join reaches, so a task sees all blocks that its queries meet
    return met.repartition(F.hash("block")).sortWithinPartitions("block")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of rows (vec_id, embedding) for each of queries, itself aside.

    queries: vec_id and embedding. Queries and codes meet in blocks; every code block is scored
    against every query block, and a block keeps `rerank` candidates a query.
    """
    spark = rows.sparkSession
    every = cut(distinct_vectors(rows))
    members = every.select("key", "vec_id").distinct()
    # the k + 1 smallest ids of each distinct vector, first in each of 64 parts of it
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    first = members.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("key", "part").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = cut(first.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    vectors = every.groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("rows"))
    vectors = cut(vectors)
    picked = vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = train(_matrix(picked["v"].combine_chunks()))
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                x = _matrix(some.column(1))
                codes, norms = shared.value.encode(x.astype(np.float32))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(shared.value.left(x, codes), pa.float64())], names=["key", "least", "codes", "norm", "left"])

    def code_blocks(batches):
        for t in _blocks(batches, CODE_BLOCK):
            yield pa.RecordBatch.from_pydict({"keys": pa.array([b"".join(t["key"].to_pylist())], pa.binary()), "least": pa.array([t["least"].to_numpy().tobytes()], pa.binary()), "codes": pa.array([b"".join(t["codes"].to_pylist())], pa.binary()), "left": pa.array([t["left"].to_numpy().tobytes()], pa.binary())})

    def scan(batches):
        """Keeps the best of each query while the code blocks of its block of queries pass by, and the
        most that the inner product with any other vector may be."""
        books = shared.value.books
        at, held, names = None, None, None

        def finish():
            for a in range(0, len(names), 256):
                keys, ids, s, u, of, most = (np.concatenate(c) for c in zip(*(held[j] + (np.full(len(held[j][1]), names[j]), np.full(len(held[j][1]), beyond[j])) for j in range(a, min(len(names), a + 256))), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(keys.tolist(), pa.binary()), pa.array(most, pa.float64())], names=["query_id", "key", "most"])

        for batch in batches:
            for block, queries, q, keys, least, codes, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield from finish()
                    at, names = block, np.frombuffer(queries, np.int64)
                    held = [(np.zeros(0, "V16"), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))] * len(names)
                    beyond = np.full(len(names), -np.inf)
                    asks = np.frombuffer(q, np.float64).reshape(-1, books.shape[2])
                    length = np.sqrt((asks * asks).sum(1)) * (1 + 1e-12)
                    tables = np.einsum("qd,mkd->mkq", asks.astype(np.float32), books, optimize=True)
                    off = shared.value.rounding()
                ids, code, key = np.frombuffer(least, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, CODEBOOKS), np.frombuffer(keys, "V16")
                slack = np.frombuffer(left, np.float64) + off
                for a in range(0, len(names), 64):
                    scores = np.zeros((len(code), len(names[a : a + 64])), np.float32)
                    for m in range(CODEBOOKS):
                        scores += tables[m, code[:, m], a : a + 64]
                    keep = min(rerank, len(code))
                    edge = -np.partition(-scores, keep - 1, axis=0)[keep - 1]
                    for j in range(len(edge)):
                        upper = scores[:, j] + length[a + j] * slack
                        some = scores[:, j] >= edge[j]
                        k0, i0, s0, u0 = held[a + j]
                        k1, i1, s1, u1 = np.concatenate([k0, key[some]]), np.concatenate([i0, ids[some]]), np.concatenate([s0, scores[some, j]]), np.concatenate([u0, upper[some]])
                        order = np.lexsort((i1, -s1))
                        best, out = order[:rerank], order[rerank:]
                        # a number that is not one stays the most, and no query passes with it
                        beyond[a + j] = np.max(np.concatenate([[beyond[a + j]], upper[~some], u1[out]]))
                        held[a + j] = k1[best], i1[best], s1[best], u1[best]
        if at is not None:
            yield from finish()

    coded = cut(vectors.select("key", "v", "least").mapInArrow(encode, "key binary, least long, codes binary, norm float, left double"))
    asked = distinct_vectors(queries).select("vec_id", "v").dropDuplicates(["vec_id"])
    asked = cut(asked)
    met = _meet(coded.select("key", "least", "codes", "left").mapInArrow(code_blocks, "keys binary, least binary, codes binary, left binary"), asked)
    near = cut(_exact(cut(met.mapInArrow(scan, "query_id long, key binary, most double")), asked, vectors, members, k))
    # the last of k + 1 must beat whatever the candidates left out
    last = near.groupBy("query_id").agg(F.max("most").alias("most"), F.min(F.when(F.col("r") == k + 1, F.col("score"))).alias("last"))
    proven = (F.col("most") == -math.inf) | F.coalesce(F.col("last") > F.col("most"), F.lit(False))
    open_ones = cut(last.where(~proven).select(F.col("query_id").alias("vec_id")))
    if not open_ones.isEmpty():
        again = _scan_exactly(vectors, asked.join(open_ones, "vec_id", "left_semi"), members, k)
        near = near.join(open_ones, near["query_id"] == open_ones["vec_id"], "left_anti").select(again.columns).unionByName(again)
    each = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    final = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return final.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan_exactly(vectors: DataFrame, asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """What _exact gives, from the inner products of every vector with each of asked, block by block."""

    def vector_blocks(batches):
        for t in _blocks(batches, CODE_BLOCK):
            yield pa.RecordBatch.from_pydict({"keys": pa.array([b"".join(t["key"].to_pylist())], pa.binary()), "least": pa.array([t["least"].to_numpy().tobytes()], pa.binary()), "x": pa.array([_matrix(t["v"].combine_chunks()).tobytes()], pa.binary()), "kind": pa.array([_matrix(t["v"].combine_chunks()).dtype.str])})

    def scan(batches):
        at, held, names = None, None, None

        def finish():
            keys, ids, s, of = (np.concatenate(c) for c in zip(*(h + (np.full(len(h[1]), name),) for h, name in zip(held, names, strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(keys.tolist(), pa.binary()), pa.array([-math.inf] * len(of), pa.float64())], names=["query_id", "key", "most"])

        for batch in batches:
            for block, queries, q, keys, least, x, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield from finish()
                    at, names = block, np.frombuffer(queries, np.int64)
                    asks = np.frombuffer(q, np.float64).reshape(len(names), -1)
                    held = [(np.zeros(0, "V16"), np.zeros(0, np.int64), np.zeros(0))] * len(names)
                ids, key, v = np.frombuffer(least, np.int64), np.frombuffer(keys, "V16"), np.frombuffer(x, kind).reshape(-1, asks.shape[1]).astype(np.float64)
                # two ways to sum a product differ by less
                off = 4 * (asks.shape[1] + 4) * np.finfo(np.float64).eps * np.sqrt((v * v).sum(1).max()) * np.sqrt((asks * asks).sum(1))
                for a in range(0, len(names), 64):
                    rough = v @ asks[a : a + 64].T
                    keep = min(k + 1, len(v))
                    edge = -np.partition(-rough, keep - 1, axis=0)[keep - 1]
                    for j in range(len(edge)):
                        k0, i0, s0 = held[a + j]
                        floor = max(edge[j], s0[-1]) if len(s0) > k else edge[j]
                        some = np.flatnonzero(~(rough[:, j] < floor - off[a + j]))
                        exact = _products(v[some], np.broadcast_to(asks[a + j], (len(some), asks.shape[1])))
                        k1, i1, s1 = np.concatenate([k0, key[some]]), np.concatenate([i0, ids[some]]), np.concatenate([s0, exact])
                        best = np.lexsort((i1, -s1))[: k + 1]
                        held[a + j] = k1[best], i1[best], s1[best]
        if at is not None:
            yield from finish()

    met = _meet(vectors.select("key", "v", "least").mapInArrow(vector_blocks, "keys binary, least binary, x binary, kind string"), asked)
    return _exact(cut(met.mapInArrow(scan, "query_id long, key binary, most double")), asked, vectors, members, k).drop("most", "r")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.float64), np.ascontiguousarray(b, np.float64))


def _exact(top: DataFrame, asked: DataFrame, vectors: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query_id, score, ids, most, r: the k + 1 best candidates by exact scores, and the rows they stand for."""
    often = top.groupBy("key").agg(F.count("*").alias("n"))
    kept = cut(vectors.select("key", "v", "least").join(members, "key").join(often, "key"))
    pairs = skew_join(top, kept, "key", "n", top.count(), "inner")
    pairs = pairs.join(asked.select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), F.col("query_id") == F.col("qid"))

    def score(batches):
        for batch in batches:
            got = _products(_matrix(batch.column(2)), _matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array(got, pa.float64())], names=["query_id", "ids", "least", "most", "score"])

    scored = pairs.select("query_id", "ids", "v", "q", "least", "most").mapInArrow(score, "query_id long, ids array<long>, least long, most double, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "least")
    near = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return near.select("query_id", "score", "ids", "most", "r")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))

"""Best-fit packing of documents into sequences after a dominance reduction.

Documents become pieces of at most `size` ids. What the packing needs of them is how many pieces
have each length, a table of at most `size` rows whatever the corpus holds. On that table the
Martello-Toth reduction fixes sequences that dominate every other one with their longest piece
(alone where nothing fits beside it; with the longest fitting piece where that fills the sequence
or no two pieces fit; with two more where three is the most and they dominate), again and again
until nothing can be fixed; best fit in order of decreasing length packs the rest. Equal pieces are
handled in runs, so the plan is short: each run puts pieces of one length, by rank among them, into
consecutive sequences. Ranks are taken over (length, salt) groups, so a length that a third of all
pieces have is spread over tasks. Edge cases:

* null text is empty: one piece, the end id; repeated rows are packed each; null doc_ids are kept;
* very long texts are cut into full pieces and a last, shorter one; an empty table gives an empty
  result; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import cut, frugal, small_batches

SIZE = 4096
SALTS = 256


class Plan:
    """Runs: pieces of a length with ranks from `rank` on, `count` of them, go `each` to a sequence
    from sequence `first` on, at places `offset`, `offset` + length, ... ."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.size = size
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _run(self, s: int, count: int, first: int, each: int, offset: int) -> None:
        self.runs.append((s, self.used[s], count, first, each, offset))
        self.used[s] += count
        self.left[s] -= count
        if not self.left[s]:
            self.sizes.remove(s)

    def _largest(self, most: int, without: dict[int, int]) -> int | None:
        """The largest length of at most `most` that is left beside the pieces in `without`."""
        k = bisect.bisect_right(self.sizes, most) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def _smallest(self, n: int, s: int) -> list[int]:
        """The n smallest pieces beside one of length s."""
        out: list[int] = []
        for x in self.sizes:
            out += [x] * min(n - len(out), self.left[x] - (x == s))
            if len(out) >= n:
                break
        return out

    def _dominant(self, s: int) -> list[int] | None:
        """The partners of a piece of length s in a set that dominates all others with it, if one is proved to."""
        room = self.size - s
        a = self._largest(room, {s: 1})
        if a is None:
            return []
        low = self._smallest(3, s)
        if a == room or len(low) < 2 or low[0] + low[1] > room:
            return [a]
        if len(low) > 2 and sum(low) <= room:
            return None
        taken = {s: 1}
        taken[a] = taken.get(a, 0) + 1
        b = self._largest(room - a, taken)
        if b is None:
            return None
        # the longest piece that can be the shorter of two partners
        y = self._largest(room // 2, {s: 1})
        while y is not None and y > b:
            beside = {s: 1}
            beside[y] = beside.get(y, 0) + 1
            x = self._largest(room - y, beside)
            if x is not None and x >= y:
                return None
            y = self._largest(y - 1, {s: 1})
        return [a, b]

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for s in sorted(self.sizes, reverse=True):
                while self.left[s]:
                    partners = self._dominant(s)
                    if partners is None:
                        break
                    group = [s, *partners]
                    bins = min(self.left[x] // group.count(x) for x in group)
                    at = 0
                    for x in dict.fromkeys(group):
                        self._run(x, bins * group.count(x), self.sequences, group.count(x), at)
                        at += x * group.count(x)
                    self.sequences += bins
                    self.fixed += bins
                    again = True

    def _best_fit(self) -> None:
        rooms: list[int] = []
        held: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in held:
                    bisect.insort(rooms, room)
                    held[room] = []
                held[room].append((first, n))

        for s in sorted(self.sizes, reverse=True):
            while self.left[s]:
                k = bisect.bisect_left(rooms, s)
                if k < len(rooms):
                    room = rooms[k]
                    first, n = held[room].pop()
                    if not held[room]:
                        del held[room], rooms[k]
                else:
                    room, first = self.size, self.sequences
                    n = -(-self.left[s] // (self.size // s))
                    self.sequences += n
                each = room // s
                full = min(n, self.left[s] // each)
                if full:
                    self._run(s, full * each, first, each, self.size - room)
                    put(room - each * s, first, full)
                if full < n and self.left[s]:
                    some = self.left[s]
                    self._run(s, some, first + full, some, self.size - room)
                    put(room - some * s, first + full, 1)
                    full += 1
                put(room, first + full, n - full)


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, size: int = SIZE, drop_space: bool = True, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and on request ids of every piece of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut_up(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, ids, at in tokens.encoded(batch.column(1), tokenizer, drop_space, end):
                view, out = memoryview(ids.astype("<u4").tobytes()), []
                for name, x, y in zip(names[a:b], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for k, p in enumerate(range(x, y, size)):
                        q = min(y, p + size)
                        out.append((name, k, p - x, q - p, zlib.crc32(view[4 * p : 4 * q])) + ((ids[p:q].astype(np.int32),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(frugal(cut_up), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces() with sequence_id and offset. rows is read twice: give it a checkpoint or a written table."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = np.array(sorted(Plan(counts, size).runs), np.int64).reshape(-1, 6)
    shared = rows.sparkSession.sparkContext.broadcast(runs)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    sizes = sizes.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), before.alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(sizes, (ranked["length"] == sizes["__l"]) & (ranked["__salt"] == sizes["__s"]))
    ranked = ranked.select(*rows.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))
    where = rows.columns.index("length")

    def place(batches):
        r = shared.value
        keys = r[:, 0] << 48 | r[:, 1]
        for batch in batches:
            length, rank = batch.column(where).to_numpy(), batch.column(len(rows_columns)).to_numpy()
            run = r[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            k = rank - run[:, 1]
            sequence, offset = run[:, 3] + k // run[:, 4], run[:, 5] + k % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*rows_columns, "sequence_id", "offset"])

    rows_columns = rows.columns
    schema = type(rows.schema).fromJson(rows.schema.jsonValue()).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(frugal(place), schema)


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """pack() of the pieces of docs (doc_id, text), on request with their ids."""
    return pack(cut(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=with_ids)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

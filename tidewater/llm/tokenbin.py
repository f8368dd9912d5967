"""Token ids in byte-aligned variable-length files with separate control bytes.

Documents go in ascending doc_id order into files of at most FILE_TOKENS ids (a longer document
alone). In each file ids are replaced by their frequency rank there, most frequent first; a rank
takes one to four bytes of the data section, and the control section holds two bits a rank with its
length. Numpy decodes a file at once: a 256-row table turns control bytes into lengths, whose
running sum says where each rank begins.

File: MAGIC, then little-endian counts of documents, ids, ranks and data bytes (uint64), the ids by
rank (uint32), doc_ids (int64), a byte a document that says whether its doc_id is null, ids a
document (int64), control bytes, data bytes.

Edge cases: null text is empty and yields its end id alone; a null doc_id sorts first and reads
back as null; rows of one doc_id stand in the order of a hash of their texts, then of the texts
(null first), so starts are the same in every run; very long texts are encoded whole; an empty table
writes no file and gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import cut, frugal, scratch_path
from .files import read_all, write_once

MAGIC = b"TWTOKEN1"
FILE_TOKENS = 8 << 20

#: Lengths less one of the four ranks that each control byte speaks of.
LENGTHS = np.array([[(c >> (2 * k)) & 3 for k in range(4)] for c in range(256)], np.uint8)


def pack(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One file: the ids of documents in a row, with their counts and doc_ids."""
    often = np.bincount(ids)
    seen = np.flatnonzero(often).astype(np.uint32)
    order = np.lexsort((seen, -often[seen]))
    rank = np.empty(len(often), np.uint32)
    rank[seen[order]] = np.arange(len(seen), dtype=np.uint32)
    r = rank[ids]
    extra = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    quads = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    quads[: len(r)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    at = ends - extra - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[at] = r & 0xFF
    for k in range(1, 4):
        some = np.flatnonzero(extra >= k)
        data[at[some] + k] = (r[some] >> np.uint32(8 * k)) & 0xFF
    head = np.array([len(doc_ids), len(ids), len(seen), len(data)], "<u8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    named = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), seen[order].astype("<u4").tobytes(), named.tobytes(), null.tobytes(), counts.astype("<i8").tobytes(), control.tobytes(), data.tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """The arguments of pack() again."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, ranks, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    place = 40

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal place
        got = np.frombuffer(raw, kind, count, place)
        place += got.nbytes
        return got

    by_rank, named, null, counts = part("<u4", ranks), part("<i8", docs), part("u1", docs), part("<i8", docs)
    extra = LENGTHS[part("u1", -(-n // 4))].reshape(-1)[:n]
    data = np.concatenate([part("u1", size), np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.cumsum(extra.astype(np.int64) + 1) - extra - 1
    r = data[at]
    for k in range(1, 4):
        some = np.flatnonzero(extra >= k)
        r[some] |= data[at[some] + k] << np.uint32(8 * k)
    return by_rank[r], counts, [None if z else int(x) for x, z in zip(named, null, strict=True)]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, drop_space: bool = False) -> DataFrame:
    """Encodes docs (doc_id, text) into files below folder; returns (place, path, n_docs, n_tokens), place in doc_id order.

    tokenizer is a file of the tokenizers library; each text gets `end` after it. Texts are dealt
    by ranges of doc_id and a hash of the text, so a task holds one file's ids at a time and rows
    of one doc_id need not meet in a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, counts, ids, size = [], [], [], 0

        def finish():
            path = write_once(folder, "tokens", pack(np.concatenate(held), np.concatenate(counts), ids))
            return pa.RecordBatch.from_pydict({"place": pa.array([part << 32 | number], pa.int64()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([size], pa.int64())})

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, got, at in tokens.encoded(batch.column(1), tokenizer, drop_space, end):
                if size and size + len(got) > FILE_TOKENS:
                    yield finish()
                    number, held, counts, ids, size = number + 1, [], [], [], 0
                held.append(got)
                counts.append(np.diff(at))
                ids += names[a:b]
                size += len(got)
        if ids:
            yield finish()

    return cut(rows.mapInArrow(frugal(write), "place long, path string, n_docs long, n_tokens long"))


def read_tokens(written: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (array) or with digest their ids_crc32.

    Only a row a file passes through the one-partition window that adds up starts; files are read by
    as many tasks.
    """
    before = F.sum("n_tokens").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    files = written.select("path", before.alias("start")).repartition(max(1, written.count()), "path")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, counts, names = unpack(read_all(path))
                ends = np.cumsum(counts)
                begins = ends - counts
                if digest:
                    view = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                whole = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(counts, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                for a in range(0, len(whole), 4096):
                    yield whole.slice(a, 4096)

    return files.mapInArrow(frugal(read), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(written, digest=True)

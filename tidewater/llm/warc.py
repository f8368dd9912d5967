"""WARC archives: a writer, and a Python data source that reads them back.

The reader plans partitions of whole files by size, takes equality and IN filters on the header
columns as pushed predicates, parses a record's header before anything else, and passes over the
payload of a record that fails a predicate, or whose payload no column asks for, without decoding
it. Archives are gzip files of one member a record, or plain.

Payloads that are equal and have at least MIN_REVISIT bytes are stored once, as the response with
the smallest page_id; the others become revisit records that refer to it and hold no payload.
Rows, columns and edge cases:

* null html is an empty payload; a null url is written as about:blank;
* smaller payloads are responses each; repeated rows with the same page_id and payload: each such
  row is written, and all rows that carry the smallest page_id are responses;
* a null page_id is left out of the header and reads back as null; its record is a revisit if a row
  with a page_id has the same payload, else a response;
* an empty table writes no archive and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import cut, scratch_path, skew_join
from .files import listed, open_fs, write_once

MIN_REVISIT = 100

#: Bytes of archive after which a writing task starts another file.
FILE_BYTES = 64 << 20

#: Bytes of archives that one reading task is given.
SPLIT_BYTES = 16 << 20

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"

#: Columns on which filters are decided from the header alone.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes")

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_bytes(record: dict, length: int) -> bytes:
    """The header of one record, with its blank line."""
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <urn:uuid:{record['record_id']}>", f"WARC-Date: {record['date']}", f"WARC-Target-URI: {record['target_uri']}"]
    if record["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {record['refers_to']}"]
    if record["page_id"] is not None:
        lines.append(f"X-Page-ID: {record['page_id']}")
    lines += [f"WARC-Payload-Digest: sha256:{record['payload_digest']}", f"X-Payload-Length: {record['payload_bytes']}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(url: str | None) -> str:
    """A URI that fits one header line."""
    return "about:blank" if url is None else "".join(x for x in url if x not in "\r\n")


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives pages (page_id, url, html) below folder; returns a table of (path, records, bytes).

    Only page ids and digests are grouped. Payloads that repeat are found by counting digests;
    those that hold much of the table are joined by broadcast and the rest by shuffle.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    long = F.col("payload_bytes") >= min_revisit
    groups = rows.where(long).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = cut(groups.where((F.col("n") > 1) & F.col("refers_to").isNotNull()))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    keyed = rows.withColumn("__key", F.when(long, F.col("payload_digest")))
    keyed = skew_join(keyed, groups.withColumnRenamed("payload_digest", "__key"), "__key", "n", total, "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    keyed = keyed.select("page_id", "url", F.when(again, None).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("refers_to")).alias("refers_to"))

    def archive(batches):
        out, records = io.BytesIO(), 0
        for batch in batches:
            for r in batch.to_pylist():
                r["record_type"] = "response" if r["refers_to"] is None else "revisit"
                body = r["payload"] or b""
                r["record_id"], r["date"], r["target_uri"] = str(uuid.uuid4()), date, _clean(r["url"])
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(header_bytes(r, len(body)) + body + b"\r\n\r\n") + z.flush())
                records += 1
                if out.tell() >= FILE_BYTES:
                    yield finish(out.getvalue(), records)
                    out, records = io.BytesIO(), 0
        if records:
            yield finish(out.getvalue(), records)

    def finish(data: bytes, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [write_once(folder, "part.warc.gz", data)], "records": pa.array([records], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return cut(keyed.mapInArrow(archive, "path string, records long, bytes long"))


class _Bytes:
    """Reads bytes of a plain or gzip archive in order and skips over them, a chunk at a time."""

    def __init__(self, raw, zipped: bool):
        self.raw, self.zip, self.held = raw, zlib.decompressobj(31) if zipped else None, bytearray()
        self.more = True

    def _fill(self) -> bool:
        if self.zip is None:
            data = self.raw.read(1 << 18)
            self.more = bool(data)
            self.held += data
            return self.more
        while True:
            data = self.zip.unused_data if self.zip.eof else b""
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            data = data or self.raw.read(1 << 18)
            if not data:
                self.more = False
                return False
            got = self.zip.decompress(data)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with the mark; None at the end of the archive."""
        at, seen = -1, 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._fill():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record header")
                return None
        got = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return got

    def take(self, n: int, keep: bool = True) -> bytes | None:
        """The next n bytes, or None without building them when they are not kept."""
        parts = []
        while n:
            if not self.held and not self._fill():
                raise ValueError("the archive ends inside a record")
            piece = min(n, len(self.held))
            if keep:
                parts.append(bytes(self.held[:piece]))
            del self.held[:piece]
            n -= piece
        return b"".join(parts) if keep else None


def parse_header(block: bytes) -> dict:
    """Named fields of a header block, names in lower case."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].strip().startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _columns(head: dict) -> dict:
    number = lambda k: int(head[k]) if k in head else None
    return {
        "record_id": head.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "page_id": number("x-page-id"),
        "refers_to": number("x-refers-to-page"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": number("x-payload-length") if "x-payload-length" in head else number("content-length"),
    }


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.schema = options["path"], schema
        self.skip_payload = options.get("payload", "true").lower() == "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS:
                self.tests.append((name, frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        plan, size = [[]], 0
        for path, n in listed(self.path, ".warc"):
            if plan[-1] and size + n > SPLIT_BYTES:
                plan.append([])
                size = 0
            plan[-1].append(path)
            size += n
        return [_Part(x) for x in plan]

    def read(self, part):
        names = self.schema.names
        for path in part.paths:
            system, at = open_fs(path)
            with system.open_input_stream(at, compression=None) as raw:
                start = raw.read(2)
            with system.open_input_stream(at, compression=None) as raw:
                source = _Bytes(raw, start == b"\x1f\x8b")
                while (block := source.until(b"\r\n\r\n")) is not None:
                    head = parse_header(block.lstrip(b"\r\n"))
                    row = _columns(head)
                    wanted = all(row[k] in values for k, values in self.tests)
                    body = source.take(int(head["content-length"]), wanted and not self.skip_payload)
                    source.take(4, False)
                    if wanted:
                        row["payload"] = body if row["record_type"] != "revisit" else None
                        yield tuple(row[k] for k in names)


class WarcSource(DataSource):
    """format("warc"): option payload=false leaves payloads unread (null)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and lengths of responses come from the payloads read back, those of revisits from their headers."""
    folder = scratch_path(spark, "warc")
    written = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not written.head(1):
        return spark.createDataFrame([], schema)
    own = F.col("record_type") == "response"
    length = F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return read_warc(spark, folder).select("page_id", length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = f"""
WITH a AS (SELECT page_id, encode(COALESCE(html, '')) AS payload FROM pages),
b AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM a),
c AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM c
"""

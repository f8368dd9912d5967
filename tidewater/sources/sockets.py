"""JSON rows over UDP datagrams and WebSocket text messages, as Python data sources and as senders.

One JSON object a datagram or message; {"eof": true} ends the source. What does not parse or does not
fit the schema is left out, or an error with on_malformed="error". A socket is one place: batch and
stream reads have one task, so these serve feeds, not bulk data. What a lost task had received is lost.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import select
import socket
import struct
import time
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .schemas import parse_schema

#: What a WebSocket server adds to a client's key (fixed value of RFC 6455).
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


def _value(x, kind: T.DataType):
    """A JSON value as a value of a column; whole numbers in time columns are nanoseconds. ValueError if it does not fit."""
    if x is None:
        return None
    if isinstance(kind, T.TimestampType):
        return datetime.fromtimestamp(x // 1000 / 1e6, timezone.utc) if isinstance(x, int) else datetime.fromisoformat(x)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(x)
    want = {T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.BooleanType: bool, T.StringType: str}[type(kind)]
    if not isinstance(x, want) or (isinstance(x, bool) and want is not bool):
        raise ValueError(f"{x!r} is no {kind.simpleString()}")
    return float(x) if isinstance(kind, T.DoubleType) else x


def parse_message(text: bytes, schema: T.StructType, strict: bool = False):
    """A row, None for what is left out, or "eof"."""
    try:
        got = json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("not a JSON object")
        if got.get("eof") is True:
            return "eof"
        return tuple(_value(got[f.name], f.dataType) for f in schema)
    except (ValueError, KeyError, TypeError) as e:
        if strict:
            raise ValueError(f"malformed message: {e}") from e
        return None


# ---- WebSocket frames


def frame(payload: bytes, masked: bool, opcode: int = 1) -> bytes:
    n, top = len(payload), 0x80 if masked else 0
    head = bytes([0x80 | opcode]) + (bytes([top | n]) if n < 126 else bytes([top | 126]) + struct.pack(">H", n) if n < 1 << 16 else bytes([top | 127]) + struct.pack(">Q", n))
    if not masked:
        return head + payload
    key = os.urandom(4)
    return head + key + bytes(b ^ key[i % 4] for i, b in enumerate(payload))


def unframe(buffer: bytearray) -> tuple[int, bytes] | None:
    """Takes the first whole frame off the buffer: (opcode, payload)."""
    if len(buffer) < 2:
        return None
    n, at = buffer[1] & 0x7F, 2
    if n >= 126:
        width = 2 if n == 126 else 8
        if len(buffer) < 2 + width:
            return None
        n, at = int.from_bytes(buffer[2 : 2 + width], "big"), 2 + width
    key = None
    if buffer[1] & 0x80:
        key, at = bytes(buffer[at : at + 4]), at + 4
    if len(buffer) < at + n or (key is not None and len(key) < 4):
        return None
    opcode, payload = buffer[0] & 0x0F, bytes(buffer[at : at + n])
    del buffer[: at + n]
    return opcode, bytes(b ^ key[i % 4] for i, b in enumerate(payload)) if key else payload


def _accept(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()


def _until_blank(s: socket.socket) -> tuple[bytes, bytearray]:
    """A request or answer's head, and what came after it."""
    data = bytearray()
    while b"\r\n\r\n" not in data:
        more = s.recv(4096)
        if not more:
            raise ConnectionError("the handshake ended early")
        data += more
    head, _, rest = bytes(data).partition(b"\r\n\r\n")
    return head, bytearray(rest)


def ws_client(host: str, port: int, path: str = "/", wait: float = 10.0) -> tuple[socket.socket, bytearray]:
    """A connection after its handshake; tries until the server is there."""
    end = time.monotonic() + wait
    while True:
        try:
            s = socket.create_connection((host, port), timeout=wait)
            break
        except OSError:
            if time.monotonic() > end:
                raise
            time.sleep(0.1)
    key = base64.b64encode(os.urandom(16)).decode()
    s.sendall(f"GET {path} HTTP/1.1\r\nHost: {host}:{port}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
    head, rest = _until_blank(s)
    if _accept(key).encode() not in head:
        raise ConnectionError("the server did not accept the handshake")
    return s, rest


# ---- receivers: messages as they come


class _Udp:
    def __init__(self, options: dict):
        self.s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 1 << 22)
        self.s.bind((options.get("host", "0.0.0.0"), int(options["port"])))  # noqa: S104  a feed comes from other machines

    def messages(self, wait: float) -> Iterator[bytes]:
        """What comes within `wait` seconds."""
        while select.select([self.s], [], [], wait)[0]:
            yield self.s.recv(1 << 16)

    def close(self) -> None:
        self.s.close()


class _WebSocket:
    """A server for any number of clients, or with the option `path` a client of one server."""

    def __init__(self, options: dict):
        self.open: dict[socket.socket, bytearray] = {}
        self.server = None
        if "path" in options:
            s, rest = ws_client(options.get("host", "127.0.0.1"), int(options["port"]), options["path"])
            self.open[s] = rest
        else:
            self.server = socket.create_server((options.get("host", "0.0.0.0"), int(options["port"])))  # noqa: S104

    def _welcome(self) -> None:
        s, _ = self.server.accept()
        s.settimeout(10)
        try:
            head, rest = _until_blank(s)
            key = next(line.split(b":", 1)[1].strip().decode() for line in head.split(b"\r\n") if line.lower().startswith(b"sec-websocket-key:"))
            s.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {_accept(key)}\r\n\r\n".encode())
        except (OSError, StopIteration):
            s.close()
            return
        self.open[s] = rest

    def messages(self, wait: float) -> Iterator[bytes]:
        end = time.monotonic() + wait
        while True:
            for s, buffer in list(self.open.items()):
                while (got := unframe(buffer)) is not None:
                    if got[0] == 1:
                        yield got[1]
                        end = time.monotonic() + wait
                    elif got[0] == 8:
                        self.open.pop(s).clear()
                        s.close()
                        break
            left = end - time.monotonic()
            ready = select.select([*([self.server] if self.server else []), *self.open], [], [], left)[0] if left > 0 else []
            if not ready:
                return
            for s in ready:
                if s is self.server:
                    self._welcome()
                elif more := s.recv(1 << 16):
                    self.open[s] += more
                else:
                    self.open.pop(s)
                    s.close()

    def close(self) -> None:
        for s in [*self.open, *([self.server] if self.server else [])]:
            s.close()


def _receiver(options: dict):
    return (_WebSocket if options["kind"] == "websocket" else _Udp)(options)


class _Batch(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        source = _receiver(self.options)
        try:
            for text in source.messages(float(self.options.get("timeout", 10))):
                row = parse_message(text, self.schema, self.options.get("on_malformed") == "error")
                if row == "eof":
                    return
                if row is not None:
                    yield row
        finally:
            source.close()


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options, self.source = schema, options, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict):
        self.source = self.source or _receiver(self.options)
        rows = []
        for text in self.source.messages(float(self.options.get("poll", 0.2))):
            row = parse_message(text, self.schema, self.options.get("on_malformed") == "error")
            if row == "eof":
                break
            if row is not None:
                rows.append(row)
            if len(rows) >= int(self.options.get("most", 10_000)):
                break
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        raise RuntimeError("messages that were received before a restart cannot be read again")


class SocketSource(DataSource):
    """Format tidewater_socket, with options kind, port, host, path, schema, on_malformed, timeout, poll, most."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_socket"

    def schema(self) -> T.StructType:
        return parse_schema(self.options["schema"])

    def reader(self, schema):
        return _Batch(schema, dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Stream(schema, dict(self.options))


def receive(spark: SparkSession, kind: str, port: int, schema: str, stream: bool = False, **options) -> DataFrame:
    """Rows of a schema in short form. As a table it ends with {"eof": true}, or `timeout` seconds without a message."""
    if kind not in ("udp", "websocket") or options.get("on_malformed", "skip") not in ("skip", "error"):
        raise ValueError("kind is udp or websocket, on_malformed is skip or error")
    spark.dataSource.register(SocketSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("tidewater_socket").options(kind=kind, port=port, schema=schema, **options).load()


def udp_recv(spark: SparkSession, port: int, schema: str, **options) -> DataFrame:
    return receive(spark, "udp", port, schema, **options)


def ws_recv(spark: SparkSession, port: int, schema: str, **options) -> DataFrame:
    """Messages that clients send to a server on port."""
    return receive(spark, "websocket", port, schema, **options)


def ws_listen(spark: SparkSession, host: str, port: int, schema: str, path: str = "/", **options) -> DataFrame:
    """Messages that a server sends to its client."""
    return receive(spark, "websocket", port, schema, host=host, path=path, **options)


def _sent(df: DataFrame, send) -> int:
    """Gives each task's rows to send(); times go as nanoseconds. Returns the number of rows."""
    kinds = {f.name: f.dataType for f in df.schema}
    rows = df.select(*(F.unix_micros(c).alias(c) * 1000 if isinstance(k, T.TimestampType) else F.col(c) for c, k in kinds.items()))
    texts = rows.toDF(*df.columns).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("m"))

    def run(batches):
        import pyarrow as pa

        n = send(m for batch in batches for m in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return texts.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def udp_send(df: DataFrame, host: str, port: int) -> int:
    """A datagram a row, from the tasks that hold the rows."""

    def send(texts) -> int:
        n = 0
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for text in texts:
                s.sendto(text.encode() + b"\n", (host, port))
                n += 1
        return n

    return _sent(df, send)


def ws_send(df: DataFrame, host: str, port: int, path: str = "/") -> int:
    """A text message a row; each task is a client of the server."""

    def send(texts) -> int:
        n, s = 0, None
        for text in texts:
            if s is None:
                s, _ = ws_client(host, port, path)
            s.sendall(frame(text.encode(), True))
            n += 1
        if s is not None:
            s.sendall(frame(b"", True, 8))
            s.close()
        return n

    return _sent(df, send)

"""Messages over sockets, on this machine."""

import json
import socket
import threading
import time

import pytest

from tidewater.sources import sockets
from tidewater.sources.schemas import parse_schema

SCHEMA = "ts:ts,symbol:str,price:f64,volume:i64"


def free_port(kind) -> int:
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_messages_are_parsed_skipped_or_refused():
    schema = parse_schema("a:i64,b:str")
    assert sockets.parse_message(b'{"a": 1, "b": "x", "c": 2}', schema) == (1, "x")
    assert sockets.parse_message(b'{"eof": true}', schema) == "eof"
    assert sockets.parse_message(b'{"a": null, "b": null}', schema) == (None, None)
    for bad in (b"not json", b"[1]", b'{"a": 1}', b'{"a": "1", "b": "x"}', b'{"a": true, "b": "x"}'):
        assert sockets.parse_message(bad, schema) is None
        with pytest.raises(ValueError):
            sockets.parse_message(bad, schema, strict=True)


@pytest.mark.parametrize("n", [0, 5, 125, 126, 70000])
@pytest.mark.parametrize("masked", [True, False])
def test_frames_round_trip(n, masked):
    data = bytearray(sockets.frame(b"x" * n, masked) + sockets.frame(b"next", masked))
    part = bytearray(data[:1])
    assert sockets.unframe(part) is None
    assert sockets.unframe(data) == (1, b"x" * n) and sockets.unframe(data) == (1, b"next") and not data


def test_udp_batch_ends_with_eof(spark):
    port = free_port(socket.SOCK_DGRAM)
    done = threading.Event()

    def send():
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            while not done.is_set():
                for k in range(3):
                    s.sendto(json.dumps({"ts": 10**18 + k * 1000, "symbol": "A", "price": 1.5, "volume": k}).encode() + b"\n", ("127.0.0.1", port))
                s.sendto(b"not json", ("127.0.0.1", port))
                s.sendto(b'{"eof":true}', ("127.0.0.1", port))
                time.sleep(0.2)

    t = threading.Thread(target=send)
    t.start()
    try:
        rows = sockets.udp_recv(spark, port, SCHEMA, timeout=20).collect()
    finally:
        done.set()
        t.join()
    # it may begin to listen in the middle of a round, and ends with the first eof
    assert len(rows) <= 3 and all(r.symbol == "A" and r.price == 1.5 and r.volume in (0, 1, 2) for r in rows)


def test_udp_sends_every_row(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        df = spark.sql("SELECT id AS n, timestamp_micros(id * 1000) AS ts, CASE WHEN id = 3 THEN NULL ELSE 'x' END AS s FROM range(5)")
        assert sockets.udp_send(df, "127.0.0.1", s.getsockname()[1]) == 5
        got = sorted((json.loads(s.recv(1000)) for _ in range(5)), key=lambda x: x["n"])
    assert got[2] == {"n": 2, "ts": 2_000_000, "s": "x"} and got[3]["s"] is None


def test_websocket_stream_gets_what_clients_send(spark, tmp_path):
    port = free_port(socket.SOCK_STREAM)
    source = sockets.ws_recv(spark, port, "n:i64,s:str", stream=True)
    query = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        df = spark.range(40).selectExpr("id AS n", "concat('v', id) AS s")
        assert sockets.ws_send(df, "127.0.0.1", port) == 40
        end = time.monotonic() + 60
        while time.monotonic() < end and sum(p["numInputRows"] for p in query.recentProgress) < 40:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.read.schema("n long, s string").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.n, r.s) for r in rows) == [(k, f"v{k}") for k in range(40)]


def test_websocket_client_listens_to_a_server(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        s, _ = server.accept()
        head, _ = sockets._until_blank(s)
        key = next(x.split(b":", 1)[1].strip().decode() for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key"))
        s.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {sockets._accept(key)}\r\n\r\n".encode())
        for k in range(4):
            s.sendall(sockets.frame(json.dumps({"n": k}).encode(), False))
        s.sendall(sockets.frame(b'{"eof": true}', False))
        time.sleep(1)
        s.close()

    t = threading.Thread(target=serve)
    t.start()
    rows = sockets.ws_listen(spark, "127.0.0.1", server.getsockname()[1], "n:i64", timeout=20).collect()
    t.join()
    server.close()
    assert sorted(r.n for r in rows) == [0, 1, 2, 3]

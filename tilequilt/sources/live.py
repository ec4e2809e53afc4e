"""Live telemetry as streaming data sources: `datagram` (UDP) and `http` (POST); each record is one row (value).

The driver listens; records wait in a bounded buffer until a batch has taken them. Both are best-effort, as telemetry
is: what arrives while the buffer is full is refused, and what was not yet taken when the query dies is not sent again.
"""

from __future__ import annotations

import json
import socket
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Fixed value: bytes of a posted record.
MOST_BYTES = 64 * 1024
#: Records that wait for a batch.
WAITING = 10_000


class Buffer:
    """Records by number, from the first that no batch has taken; thread-safe."""

    def __init__(self) -> None:
        self.first, self.rows, self.lock = 0, [], threading.Lock()

    def put(self, row: str) -> bool:
        with self.lock:
            if len(self.rows) >= WAITING:
                return False
            self.rows.append(row)
            return True

    def since(self, start: int) -> tuple[list[str], int]:
        """Records from number start on, and the number after the last; a later start than all moves the numbers on."""
        with self.lock:
            if start > self.first + len(self.rows):
                self.first = start - len(self.rows)
            return self.rows[max(0, start - self.first) :], self.first + len(self.rows)

    def between(self, start: int, end: int) -> list[str]:
        with self.lock:
            return self.rows[max(0, start - self.first) : max(0, end - self.first)]

    def drop(self, end: int) -> None:
        with self.lock:
            n = min(len(self.rows), max(0, end - self.first))
            del self.rows[:n]
            self.first += n


def hear_datagrams(host: str, port: int, buffer: Buffer) -> None:
    """Put each datagram into buffer, from a thread that ends with the process."""
    ear = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    ear.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    ear.bind((host, port))

    def listen() -> None:
        while True:
            buffer.put(ear.recv(1 << 16).decode("utf-8", "replace"))

    threading.Thread(target=listen, daemon=True).start()


def hear_posts(host: str, port: int, buffer: Buffer) -> None:
    """Put the body of each POST to /telemetry into buffer: 204 if taken, 400 if no JSON, 404 elsewhere, 413 if too large, 503 if the buffer is full."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = b"" if size > MOST_BYTES else self.rfile.read(size)
            self.send_response(404 if self.path != "/telemetry" else 413 if size > MOST_BYTES else self._taken(body))
            self.end_headers()

        def _taken(self, body: bytes) -> int:
            try:
                record = json.dumps(json.loads(body))
            except ValueError:
                return 400
            return 204 if buffer.put(record) else 503

        def log_message(self, *args) -> None:
            pass

    threading.Thread(target=ThreadingHTTPServer((host, port), Handler).serve_forever, daemon=True).start()


class _Live(SimpleDataSourceStreamReader):
    def __init__(self, hear, options: dict) -> None:
        self.hear, self.host, self.port, self.buffer = hear, options.get("host", "0.0.0.0"), int(options.get("port", 9090)), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"buffer": None}  # executors get the rows, not the ear

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.buffer is None:
            self.buffer = Buffer()
            self.hear(self.host, self.port, self.buffer)
        rows, end = self.buffer.since(start["at"])
        return iter([(r,) for r in rows]), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(r,) for r in self.buffer.between(start["at"], end["at"])] if self.buffer else [])

    def commit(self, end: dict) -> None:
        if self.buffer:
            self.buffer.drop(end["at"])


class DatagramSource(DataSource):
    """Options: host, port (9090)."""

    @classmethod
    def name(cls) -> str:
        return "datagram"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Live(hear_datagrams, dict(self.options))


class HttpSource(DataSource):
    """Options: host, port (9090)."""

    @classmethod
    def name(cls) -> str:
        return "http"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Live(hear_posts, dict(self.options))

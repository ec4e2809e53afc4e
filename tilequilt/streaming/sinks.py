"""Best-effort sinks of metrics documents: datagrams and HTTP posts. A lost record is replaced by the next one."""

from __future__ import annotations

import logging
import socket
import urllib.request

from pyspark.sql import DataFrame, Row

from ..operators.telemetry import metrics_document

#: Seconds that a post may take.
TIMEOUT = 1.0


class Datagrams:
    """A foreach writer that sends each row's document as one datagram; failures are logged, never raised."""

    def __init__(self, host: str = "255.255.255.255", port: int = 9090) -> None:
        self.host, self.port = host, port

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_BROADCAST, 1)
        return True

    def process(self, row: Row) -> None:
        try:
            self.socket.sendto(row["document"].encode(), (self.host, self.port))
        except OSError as e:
            logging.getLogger(__name__).warning("datagram not sent: %s", e)

    def close(self, error: Exception | None) -> None:
        self.socket.close()


class Posts:
    """A foreach writer that posts each row's document; failures are logged, never raised."""

    def __init__(self, url: str, timeout: float = TIMEOUT) -> None:
        self.url, self.timeout = url, timeout

    def open(self, partition_id: int, epoch_id: int) -> bool:
        return True

    def process(self, row: Row) -> None:
        request = urllib.request.Request(self.url, row["document"].encode(), {"Content-Type": "application/json"})
        try:
            urllib.request.urlopen(request, timeout=self.timeout).close()
        except OSError as e:
            logging.getLogger(__name__).warning("metrics not posted: %s", e)

    def close(self, error: Exception | None) -> None:
        pass


class FanOut:
    """A foreach writer that hands each row to several writers; what one of them fails at does not keep it from the others."""

    def __init__(self, *writers) -> None:
        self.writers = writers

    def _each(self, call) -> None:
        for w in self.writers:
            try:
                call(w)
            except Exception as e:
                logging.getLogger(__name__).warning("%s failed: %s", type(w).__name__, e)

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self._each(lambda w: w.open(partition_id, epoch_id))
        return True

    def process(self, row: Row) -> None:
        self._each(lambda w: w.process(row))

    def close(self, error: Exception | None) -> None:
        self._each(lambda w: w.close(error))


def documents(rows: DataFrame) -> DataFrame:
    """(document) of each metrics row."""
    return rows.select(metrics_document().alias("document"))


def send(rows: DataFrame, writer: Datagrams | Posts | FanOut, checkpoint: str, every: str = "1 second"):
    """Start a query that hands the documents of a stream of metrics rows to a writer."""
    return documents(rows).writeStream.foreach(writer).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

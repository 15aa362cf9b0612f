"""Sends rows to HTTP, TCP, UDP and syslog endpoints, a connection a partition."""

from __future__ import annotations

import socket
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.route import rfc5424_line
from ..ship import map_arrow

TIMEOUT = 10.0


def json_lines(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON object, nulls written out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def syslog_lines(events: DataFrame, *, level: str = "level", received_at: str = "received_at", source_host: str = "source_host", event_id: str = "event_id", raw_xml: str = "raw_xml") -> DataFrame:
    """value: each event as an RFC 5424 line."""
    return events.select(rfc5424_line(*map(F.col, (level, received_at, source_host, event_id, raw_xml))).alias("value"))


def forward(lines: DataFrame, url: str, *, headers: dict[str, str] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """One row a partition that has lines: sent, failed, error (the last one, or null). Lines are column ``value``; null ones are left out.

    ``http(s)://``: a POST a line. ``tcp://``: lines ended by a line feed. ``udp://`` and ``syslog://``: a datagram a line.
    A line that can't be sent is counted and the next one is tried; a task that is run again sends its lines again (at least once).
    """
    scheme = urlsplit(url).scheme
    if scheme not in ("http", "https", "tcp", "udp", "syslog"):
        raise ValueError(f"no way to send to {url!r}")
    given = dict(headers or {})

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sent = failed = 0
        error = None
        with _Sender(scheme, url, given, timeout) as sender:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    try:
                        sender.send(line.encode("utf-8"))
                        sent += 1
                    except (OSError, urllib.error.URLError) as e:
                        failed, error = failed + 1, str(e)
        if sent or failed:
            yield pa.RecordBatch.from_pydict({"sent": [sent], "failed": [failed], "error": pa.array([error], pa.string())})

    return map_arrow(lines.where(F.col("value").isNotNull()).select("value"), each, "sent long, failed long, error string")


class _Sender:
    def __init__(self, scheme: str, url: str, headers: dict[str, str], timeout: float):
        self.scheme, self.url, self.headers, self.timeout = scheme, url, headers, timeout
        parts = urlsplit(url)
        self.address = (parts.hostname or "", parts.port or {"syslog": 514}.get(scheme, 0))
        self.socket: socket.socket | None = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if self.socket is not None:
            self.socket.close()
            self.socket = None

    def send(self, data: bytes) -> None:
        if self.scheme.startswith("http"):
            request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", **self.headers}, method="POST")
            with urllib.request.urlopen(request, timeout=self.timeout):
                return
        if self.socket is None:
            if self.scheme == "tcp":
                self.socket = socket.create_connection(self.address, self.timeout)
            else:
                self.socket = socket.socket(socket.AF_INET6 if ":" in self.address[0] else socket.AF_INET, socket.SOCK_DGRAM)
        try:
            if self.scheme == "tcp":
                self.socket.sendall(data + b"\n")
            else:
                self.socket.sendto(data, self.address)
        except OSError:
            self.close()  # the next line connects anew
            raise

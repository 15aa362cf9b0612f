"""Streaming sources for UDP datagrams and TCP lines, and the batch forms of the same frames."""

from __future__ import annotations

import contextlib
import queue
import socket
import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "seq long, received_at timestamp, exporter string, payload binary"
MAX_LINE = 256 << 10
#: Connections that are open at once.
CONNECTIONS = 1024
#: Records that wait between two batches; more are dropped and counted.
WAITING = 100_000


class _Listener:
    """Receives on a thread of its own into a bounded queue."""

    def __init__(self, protocol: str, host: str, port: int, max_line: int, most: int = CONNECTIONS):
        self.queue: queue.Queue = queue.Queue(WAITING)
        #: Records dropped because the queue was full, lines over ``max_line``, connections refused over ``most``.
        self.dropped = self.oversize = self.refused = 0
        self.max_line, self.most, self.open = max_line, most, 0
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if protocol == "udp" else socket.SOCK_STREAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        if protocol == "tcp":
            self.socket.listen(128)
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._udp if protocol == "udp" else self._tcp, daemon=True).start()

    def counters(self, source: str) -> dict[str, int]:
        """What was lost so far, by the counters' names."""
        return {f"{source}_dropped": self.dropped, f"{source}_oversized_lines": self.oversize, f"{source}_tcp_connections_rejected": self.refused}

    def _put(self, peer: str, data: bytes) -> None:
        try:
            self.queue.put_nowait((time.time(), peer, data))
        except queue.Full:
            self.dropped += 1

    def _udp(self) -> None:
        while True:
            try:
                data, peer = self.socket.recvfrom(65535)
            except OSError:
                return
            self._put(peer[0], data)

    def _tcp(self) -> None:
        while True:
            try:
                connection, peer = self.socket.accept()
            except OSError:
                return
            if self.open >= self.most:
                self.refused += 1
                connection.close()
                continue
            self.open += 1
            threading.Thread(target=self._connection, args=(connection, peer[0]), daemon=True).start()

    def _connection(self, connection: socket.socket, peer: str) -> None:
        try:
            self._lines(connection, peer)
        finally:
            self.open -= 1

    def _lines(self, connection: socket.socket, peer: str) -> None:
        with connection, contextlib.suppress(OSError), connection.makefile("rb") as f:
            while line := f.readline(self.max_line + 1):
                if len(line) > self.max_line and not line.endswith(b"\n"):
                    self.oversize += 1
                    return  # an oversize line ends its connection
                if line := line.rstrip(b"\r\n"):
                    self._put(peer, line)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.listener = _Listener(options.get("protocol", "udp"), options.get("host", "0.0.0.0"), int(options.get("port", "0")), int(options.get("maxLine", MAX_LINE)))
        self.most = int(options.get("maxRecords", "100000"))

    def initialOffset(self):
        return {"seq": 0}

    def read(self, start):
        rows, seq = [], start["seq"]
        while len(rows) < self.most:
            try:
                at, peer, data = self.listener.queue.get_nowait()
            except queue.Empty:
                break
            rows.append((seq, _stamp(at), peer, data))
            seq += 1
        return iter(rows), {"seq": seq}

    def readBetweenOffsets(self, start, end):
        return iter([])  # the reader keeps batches itself until they are committed

    def commit(self, end):
        pass


def _stamp(seconds: float):
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


class NetworkSource(DataSource):
    """``spark.readStream.format("logspindle_net")`` with the options protocol (udp, tcp), host, port, maxLine, maxRecords."""

    @classmethod
    def name(cls):
        return "logspindle_net"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NetworkSource)


def lines_of(datagrams: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """value, source, received_at, seq of text records (bad UTF-8 replaced), without oversize ones."""
    rows = datagrams if max_bytes is None else datagrams.where(F.octet_length("payload") <= max_bytes)
    return rows.select(F.make_valid_utf8(F.col("payload").cast("string")).alias("value"), F.col("exporter").alias("source"), "received_at", "seq")


def read_lines(spark: SparkSession, path: str, max_bytes: int = MAX_LINE) -> DataFrame:
    """Lines of text files; blank and oversize ones are left out."""
    return spark.read.text(path).where((F.length(F.trim("value")) > 0) & (F.octet_length("value") <= max_bytes))


def read_datagrams(spark: SparkSession, path: str, *, exporter: Column | None = None) -> DataFrame:
    """A file a datagram; seq rises with the files' paths, so capture order is name order. The exporter is the name of a file's folder, or ``exporter`` (of path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).orderBy("path")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)
    return files.select(F.monotonically_increasing_id().alias("seq"), F.col("modificationTime").alias("received_at"), (folder if exporter is None else exporter).alias("exporter"), F.col("content").alias("payload"))


#: Query lines as the usual name servers write them, and lines with payloads, for trying things out.
EXAMPLES = [
    "<29>Mar  3 04:05:06 ns-a named[311]: client 203.0.113.9#40001: query: shop.test IN A + (198.51.100.4)",
    "<29>Mar  3 04:05:07 ns-b unbound[17]: info: 203.0.113.10 mail.test. MX IN",
    "<29>Mar  3 04:05:08 ns-c pdns[5]: Remote 203.0.113.11 wants 'img.test|AAAA'",
    '<165>1 2024-03-03T04:05:09.250Z ns-d named 88 Q7 [zone@64512 view="inner"] client 203.0.113.12#5353: query: a.test IN TXT + (198.51.100.5)',
    "<134>Mar  3 04:05:10 edge fw: CEF:0|Northwall|Edge|4.2|drop-17|Packet dropped|4|src=203.0.113.13 dpt=23",
    "<85>Mar  3 04:05:11 vault radiusd[9]: Login OK: [maren] (from client wlan port 3 cli 203.0.113.14)",
]


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, line) for i, line in enumerate(EXAMPLES)], "seq long, value string")

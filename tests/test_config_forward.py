"""Settings, forwarders, windows that begin at a request, counters."""

import http.server
import json
import socket
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspindle import config
from logspindle.operators import counters, ingest, route, stats
from logspindle.sources import forward, network, sinks


def test_the_last_layer_wins(tmp_path):
    (tmp_path / "a.toml").write_text('bind_address = "1.1.1.1:1"\n[syslog]\nudp_port = 514\nenabled = true\n')
    (tmp_path / "b.toml").write_text("[syslog]\nudp_port = 515\n")
    files = [tmp_path / "a.toml", tmp_path / "missing.toml", tmp_path / "b.toml"]
    env = {"WEF__SYSLOG__TCP_PORT": "601", "wef__syslog__enabled": "false", "WEF_SYSLOG": "no", "WEF____X": "no", "PATH": "/bin", "WEF__TLS": "x", "WEF__TLS__CERT": "c.pem"}
    got = config.load(files, env)
    assert got == {"bind_address": "1.1.1.1:1", "syslog": {"udp_port": 515, "enabled": False, "tcp_port": 601}, "tls": {"cert": "c.pem"}}
    assert config.load([], {}) == config.DEFAULTS
    (tmp_path / "bad.toml").write_text("= 1")
    with pytest.raises(ValueError):
        config.load([tmp_path / "bad.toml"], {})


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(i, f"h{i}", "a\r\nb", None) for i in range(5)], "event_id int, source_host string, raw_xml string, level string").withColumn("received_at", F.lit("2024-01-01T00:00:00Z"))


def test_http(events):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["X-Key"], body))
            self.send_response(500 if body["event_id"] == 3 else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        out = forward.forward(forward.json_lines(events), f"http://127.0.0.1:{server.server_port}/in", headers={"X-Key": "k"}).collect()
        server.shutdown()
    assert sum(r.sent for r in out) == 4 and sum(r.failed for r in out) == 1 and any("500" in (r.error or "") for r in out)
    assert sorted(b["event_id"] for _, b in got) == list(range(5)) and {k for k, _ in got} == {"k"} and got[0][1]["level"] is None


def test_tcp_and_syslog(events):
    with socket.create_server(("127.0.0.1", 0)) as server:
        seen = []

        def accept():
            server.settimeout(20)
            while sum(x.count(b"\n") for x in seen) < 5:
                with server.accept()[0] as c:
                    while part := c.recv(65536):
                        seen.append(part)

        reader = threading.Thread(target=accept, daemon=True)
        reader.start()
        out = forward.forward(forward.json_lines(events), f"tcp://127.0.0.1:{server.getsockname()[1]}").collect()
        reader.join(20)
    assert sum(r.sent for r in out) == 5 and sorted(json.loads(x)["event_id"] for x in b"".join(seen).splitlines()) == list(range(5))
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(20)
        forward.forward(forward.syslog_lines(events.where("event_id = 2")), f"syslog://127.0.0.1:{s.getsockname()[1]}").collect()
        assert s.recv(65535) == b"<134>1 2024-01-01T00:00:00Z h2 WEF - - [2] a b"


def test_what_cannot_be_sent_is_counted(events):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))  # bound, but nothing listens
        out = forward.forward(forward.json_lines(events), f"tcp://127.0.0.1:{s.getsockname()[1]}").collect()
    assert sum(r.failed for r in out) == 5 and all(r.error for r in out)
    with pytest.raises(ValueError):
        forward.forward(events, "ftp://x")


def test_generic_layout(spark, tmp_path):
    bodies = spark.createDataFrame([(1, bytearray(b'{"event":1,"sourcetype":"../Up"}'), "d"), (2, bytearray(b'{"event":2}'), "d")], "body_id long, body binary, default_sourcetype string")
    sinks.write_generic(ingest.hec_events(bodies), str(tmp_path), at=F.lit("2026-03-07").cast("timestamp"))
    rows = spark.read.parquet(str(tmp_path)).collect()
    assert {r.sourcetype for r in rows} == {"../Up", "d"} and all("/" not in r.segment and ".." != r.segment for r in rows)


def test_windows_begin_at_a_request(spark):
    t = datetime(2024, 1, 1)
    at = [0, 30, 60, 61, 62, 200]
    rows = [(i, "a", t + timedelta(seconds=s)) for i, s in enumerate(at)] + [(10, None, t), (11, "b", None), (12, None, t), (13, None, t)]
    out = stats.anchored_window_limit(spark.createDataFrame(rows, "n int, ip string, ts timestamp"), ties=("n",), most=2).collect()
    assert {r.n: r.allowed for r in out} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 10: True, 11: None, 12: True, 13: False}
    none = spark.createDataFrame([], "ip string, ts timestamp")
    assert stats.anchored_window_limit(none).collect() == []


def test_counters_of_edge_cases(spark):
    text = spark.createDataFrame([(None,), ("",), ("{",), ("[1]",), ('{"_path":7}',), ('{"_path":"conn"}',), ('{"_path":"' + "x" * 90 + '"}',)], "value string")
    got = {(r.metric, r.label): r.value for r in counters.stream_counters(text, "zeek", max_bytes=50).collect()}
    assert got == {("zeek_parse_errors", None): 1, ("zeek_oversized_lines", None): 1, ("zeek_records_received", None): 3, ("zeek_missing_path", None): 2, ("zeek_records_by_path", "unknown"): 2, ("zeek_records_by_path", "conn"): 1}
    lines = spark.createDataFrame([(None,), ("",), ("noise",), ("<34>Mar  3 04:05:06 h su: x",)], "value string")
    got = {(r.metric, r.label): r.value for r in counters.syslog_counters(lines, year=2024).collect()}
    assert got == {("syslog_messages_received", None): 3, ("syslog_parse_errors", None): 2}
    bodies = spark.createDataFrame([(1, bytearray(b"\xff"), "d"), (2, bytearray(b" \n"), "d"), (3, None, "d"), (4, bytearray(b'{"event":1}\n{"event":2}'), "d")], "body_id long, body binary, default_sourcetype string")
    assert {r.metric: r.value for r in counters.hec_counters(bodies).collect()} == {"hec_events_received": 2, "hec_parse_errors": 2}
    assert network._Listener("udp", "127.0.0.1", 0, 10).counters("zeek") == {"zeek_dropped": 0, "zeek_oversized_lines": 0, "zeek_tcp_connections_rejected": 0}


def test_large_caps_are_joined_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "a"), (5, "d")], "seq long, k string")
    small = sorted(map(str, route.cap_partitions(rows, "k", "seq", 3).collect()))
    monkeypatch.setattr(route, "BROADCAST_KEYS", 0)
    out = route.cap_partitions(rows, "k", "seq", 3)
    assert sorted(map(str, out.collect())) == small and "BroadcastHashJoin" not in out._jdf.queryExecution().toString()

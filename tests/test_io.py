"""Sinks, sources, streams, and the driver contract."""

import socket
import time

from pyspark.sql import functions as F

import test_flows
from logspindle.operators import flows, json_streams, sflow, syslog, windows_events
from logspindle.sources import network, sinks


def test_zeek_layout(spark, tmp_path):
    df = spark.createDataFrame([('{"_path":"conn","uid":"a"}',), ('{"_path":"odd/one","uid":"b"}',)], "value string")
    sinks.write_zeek(json_streams.parse_lines(df, "_path"), str(tmp_path), at=F.lit("2026-03-07").cast("timestamp"))
    assert list((tmp_path / "conn/year=2026/month=03/day=07").glob("*.zstd.parquet"))
    assert list((tmp_path / "segment=odd_one/year=2026/month=03/day=07").glob("*.zstd.parquet"))
    assert spark.read.parquet(str(tmp_path / "conn")).first().uid == "a"


def test_capped_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, "b"), (3, "c")], "seq long, k string")
    sinks.write_capped(df, str(tmp_path), "k", "seq", 2)
    assert {p.name for p in tmp_path.iterdir() if p.is_dir()} == {"segment=a", "segment=b", "segment=_overflow"}


def test_tables_of_every_kind(spark, tmp_path):
    at = F.lit("2026-03-07").cast("timestamp")
    lines = spark.createDataFrame([("<34>Mar  3 04:05:06 h su: x",), ("<34>Mar  3 04:05:06 h fw: CEF:0|A|B|1|2|C|5|k=v",), ("noise",)], "value string")
    parsed = syslog.parse_syslog(lines, year=2024)
    sinks.write_syslog(parsed, str(tmp_path / "syslog"), at=at)
    sinks.write_structured(parsed, str(tmp_path / "structured"), at=at)
    assert spark.read.parquet(str(tmp_path / "syslog")).count() == 2
    assert (tmp_path / "structured/payload_type=cef/year=2026/month=03/day=07").is_dir()
    frame = lambda text: spark.createDataFrame([(0, "e", bytearray.fromhex(text))], "seq long, exporter string, payload binary")
    sinks.write_flows(flows.decode_datagrams(frame(test_flows.V5)), str(tmp_path / "ipfix"), at=at)
    assert spark.read.parquet(str(tmp_path / "ipfix")).first().protocol_version == 5
    sinks.write_sflow(sflow.decode_sflow(frame(test_flows.SFLOW_IP4)), str(tmp_path / "sflow"), at=at)
    assert spark.read.parquet(str(tmp_path / "sflow/flow")).count() == 1
    events = windows_events.extract_fields(spark.createDataFrame([("h", "s", "<Event><System><EventID>7</EventID></System>")], "source_host string, subscription_id string, raw_xml string"))
    sinks.write_events(events, str(tmp_path / "events"), at=at)
    assert (tmp_path / "events/event_id=7/year=2026/month=03/day=07").is_dir()


def test_connections_are_capped():
    listener = network._Listener("tcp", "127.0.0.1", 0, 10, 1)
    with socket.create_connection(("127.0.0.1", listener.port)) as a:
        a.sendall(b"one\n")
        assert listener.queue.get(timeout=5)[2] == b"one"
        with socket.create_connection(("127.0.0.1", listener.port)) as b:
            assert b.recv(1) == b"" and listener.refused == 1
        a.sendall(b"x" * 30)
        end = time.time() + 5
        while not listener.oversize and time.time() < end:
            time.sleep(0.05)
    assert listener.oversize == 1


def test_stream_parse_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("<34>Oct 11 22:14:15 h su: x\nnoise\n<35>Oct 11 22:14:16 h su: y\n")
    stream = syslog.parse_syslog(spark.readStream.text(str(tmp_path / "in")), year=2024)
    sinks.stream_to(stream.select("value", "priority"), lambda b: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ckpt")).awaitTermination(120)
    batch = syslog.parse_syslog(network.read_lines(spark, str(tmp_path / "in")), year=2024).select("value", "priority")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_tcp_listener_frames_lines():
    listener = network._Listener("tcp", "127.0.0.1", 0, 20)
    with socket.create_connection(("127.0.0.1", listener.port)) as s:
        s.sendall(b"one\r\n\ntwo\n" + b"x" * 50 + b"\nlost\n")
    got = []
    end = time.time() + 5
    while len(got) < 2 and time.time() < end:
        if not listener.queue.empty():
            got.append(listener.queue.get()[2])
    time.sleep(0.2)
    assert got == [b"one", b"two"] and listener.queue.empty()


def test_udp_source_reads(tmp_path):
    reader = network._Reader({"protocol": "udp", "host": "127.0.0.1", "port": "0"})
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"abc", ("127.0.0.1", reader.listener.port))
    time.sleep(0.3)
    rows, offset = reader.read(reader.initialOffset())
    assert [r[3] for r in rows] == [b"abc"] and offset == {"seq": 1}


def test_contract(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"syslog_rfc3164_parse", "ipfix_decode", "throughput_snapshot"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0

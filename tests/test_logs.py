"""Golden records for the log parsers."""

import json

from pyspark.sql import functions as F

from logspindle.functions import expr as X
from logspindle.operators import ingest, json_streams, payload, route, stats, syslog, windows_events


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string")


def parse(spark, *values, **options):
    return [r for r in syslog.parse_syslog(lines(spark, *values), year=2024, **options).orderBy("seq").collect()]


def test_rfc3164_and_rfc5424(spark):
    a, b, c, d, e, f = parse(
        spark,
        "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
        "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - 'su root' failed for lonvick",
        '<165>1 2003-08-24T05:14:15.000003-07:00 192.0.2.1 myproc 8710 - [example@32473 iut="3" eventSource="Application" eventID="1011"] An application event log entry',
        "garbage", "<999>Oct 11 22:14:15 h a: b", "<13>Feb 30 01:02:03 h app[12]: x",
    )
    assert (a.priority, a.severity, a.facility, a.hostname, a.app_name, a.protocol) == (34, 2, 4, "mymachine", "su", "Rfc3164")
    assert a.timestamp.isoformat() == "2024-10-11T22:14:15"
    assert (b.priority, b.app_name, b.protocol, b.msg_id, b.proc_id) == (34, "su", "Rfc5424", "ID47", None)
    assert b.message == "- 'su root' failed for lonvick"  # the nil value stays unless strict
    assert c.structured_data == {"example@32473": {"iut": "3", "eventSource": "Application", "eventID": "1011"}}
    assert c.message == "An application event log entry" and c.timestamp.isoformat() == "2003-08-24T12:14:15.000003"
    assert d.protocol is None and e.protocol is None
    assert (f.timestamp, f.app_name, f.proc_id, f.message) == (None, "app", "12", "x")


def test_brackets_in_messages_and_strict_mode(spark):
    line = '<34>1 2003-10-11T22:14:15Z h a - - [x@1 k="v"] before [note] after'
    (loose,), (strict,) = parse(spark, line), parse(spark, line, strict_rfc=True)
    assert loose.structured_data == {"x@1": {"k": "v"}, "note": {}} and loose.message == "after"
    assert strict.structured_data == {"x@1": {"k": "v"}} and strict.message == "before [note] after"
    assert parse(spark, "<34>1 2003-10-11T22:14:15Z h a - - - hi", strict_rfc=True)[0].message == "hi"


def test_untagged_payload_prefix_is_taken_for_a_tag(spark):
    (r,) = parse(spark, "<134>Jan 15 10:30:45 fw01 CEF:0|V|FW|1.0|S|N|6|src=1.1.1.1")
    assert r.app_name == "CEF" and r.message.startswith("0|V")


def test_names(spark):
    df = spark.createDataFrame([(6, 4), (9, 31)], "s int, f int")
    assert [tuple(r) for r in df.select(X.severity_name(F.col("s")), X.facility_name(F.col("f"))).collect()] == [("INFO", "security"), ("UNKNOWN(9)", "UNKNOWN(31)")]


def dns(spark, *messages):
    return [r.dns for r in syslog.parse_dns(spark.createDataFrame([(m,) for m in messages], "message string")).collect()]


def test_dns(spark):
    a, b, c, d = dns(
        spark, "client 192.168.1.100#12345: query: example.com IN A + (192.168.1.1)", "x info: 10.0.0.1 example.org.. AAAA IN", "Remote 10.0.0.2 wants 'example.net|MX'", "client 10.0.0.1#1: query: a.b IN AAAA + (::1)"
    )
    assert (a.client_ip, a.query_name, a.query_type, a.response_ips) == ("192.168.1.100", "example.com", "A", ["192.168.1.1"])
    assert (b.query_name, b.query_type, b.response_ips) == ("example.org", "AAAA", [])
    assert (c.query_name, c.query_type) == ("example.net", "MX") and d is None


def one(spark, parse, text):
    r = spark.createDataFrame([(text,)], "m string").select(parse(F.col("m")).alias("r")).first().r
    return r.asDict() if r is not None else None


def test_cef(spark):
    text = r"CEF:0|Northwall|Edge \\ Guard|4.2|drop-17|Dropped \| inner|7|dvc=192.0.2.7 note=a\=b c d  seen=5 blank= chain=k=v"
    r = one(spark, payload.cef, text)
    assert (r["version"], r["device_vendor"], r["device_product"], r["name"], r["severity"]) == (0, "Northwall", "Edge \\ Guard", "Dropped | inner", "7")
    assert r["extensions"] == {"dvc": "192.0.2.7", "note": "a=b c d", "seen": "5", "blank": "", "k": "v", "chain": ""} or r["extensions"] == {"dvc": "192.0.2.7", "note": "a=b c d", "seen": "5", "blank": "", "chain": "k=v"}
    assert one(spark, payload.cef, "CEF:0|A|B|1|2|C|5|x=1 y=2 x=3 y=4 z=5")["extensions"] == {"x": "3", "y": "4", "z": "5"}
    assert one(spark, payload.cef, "CEF:1|A|B|1|2|C|5|")["extensions"] == {}
    assert one(spark, payload.cef, "CEF:0|A|B|1|2") is None
    assert one(spark, payload.cef, "CEF:300|A|B|1|2|C|5|") is None
    assert one(spark, payload.cef, "CEF:0|A|B|1|2|C|5|x=\u0001\u0002y")["device_vendor"] == "A"  # text with the mark that parts are cut at


def test_leef(spark):
    a = one(spark, payload.leef, "LEEF:1.0|Southgate|Sensor|3.3|probe|src=192.0.2.21\tport=77\tusrName=ines")
    assert a["delimiter"] is None and a["attributes"] == {"src": "192.0.2.21", "port": "77", "usrName": "ines"}
    b = one(spark, payload.leef, "LEEF:2.0|Southgate|Sensor|3.4|probe|0x3B|src=192.0.2.22;port=78;usrName=otto")
    assert b["delimiter"] == ";" and b["attributes"] == {"src": "192.0.2.22", "port": "78", "usrName": "otto"}
    assert one(spark, payload.leef, "LEEF:2.0|A|B|c|D|0x3B")["attributes"] == {}
    assert one(spark, payload.leef, "LEEF:2.0|A|B|c|D|^a=1^b=2^a=3")["attributes"] == {"a": "3", "b": "2"}
    assert one(spark, payload.leef, "LEEF:2.0|A|B") is None


def test_auditd(spark):
    r = one(spark, payload.auditd, 'type=EXECVE msg=audit(1711111111.222:77): arch=b7 comm="my tool" exe="/opt/tool" a=1 a=2 stop here=no')
    assert (r["record_type"], r["audit_id"]) == ("EXECVE", "1711111111.222:77")
    assert r["fields"] == {"arch": "b7", "comm": "my tool", "exe": "/opt/tool", "a": "2"}


def test_dhcp_radius_web(spark):
    assert one(spark, payload.dhcp, "DHCPACK on 10.0.0.5 to aa:bb:cc:dd:ee:ff (myhost) via eth0") == {"message_type": "DHCPACK", "ip": "10.0.0.5", "mac": "aa:bb:cc:dd:ee:ff", "hostname": "myhost", "interface": "eth0"}
    assert one(spark, payload.dhcp, "DHCPDISCOVER from aa:bb:cc:dd:ee:ff")["ip"] is None
    assert one(spark, payload.radius, "Login OK: [alice] (from client vpn port 10 cli 10.0.0.5)") == {"outcome": "ok", "method": None, "username": "alice", "client": "vpn", "port": "10", "client_ip": "10.0.0.5"}
    assert one(spark, payload.radius, "Login incorrect (PAP): [charlie] (from client vpn port 10 cli 10.0.0.7)")["method"] == "PAP"
    w = one(spark, payload.web_access, '10.0.0.1 - - [15/Jan/2024:10:31:00 +0000] "POST /login HTTP/1.1" 302 0 "-" "curl/7.68.0"')
    assert (w["status"], w["bytes"], w["authuser"], w["ident"], w["referer"], w["user_agent"]) == (302, 0, None, "-", None, "curl/7.68.0")


def test_dispatch_order_and_records(spark):
    df = syslog.parse_syslog(lines(spark, "<134>Mar  3 04:05:10 edge guard: CEF:0|Northwall|Edge|4.2|drop-17|Packet dropped|6|src=192.0.2.9", "<30>Jan 15 10:30:45 h x: plain"), year=2024)
    (r,) = payload.structured_records(df).collect()
    assert r.payload_type == "cef" and json.loads(r.parsed)["severity"] == "6"


def test_windows_events(spark):
    body = (
        "<Envelope><Body><Events><Event><System><Provider>Sec</Provider><EventID>4624</EventID><Level>4</Level><TimeCreated>2024-01-01T00:00:00Z</TimeCreated><Computer>pc</Computer></System>"
        "<EventData><Data> logged &amp; on </Data></EventData></Event><Event xmlns='x'><System><EventID>bad</EventID><Level>0</Level><TimeCreated SystemTime='2024-01-02T00:00:00Z'/></System></Event><Event/></Events></Body></Envelope>"
    )
    df = spark.createDataFrame([("h", body)], "source_host string, body string")
    a, b = windows_events.extract_fields(windows_events.split_events(df)).orderBy("event_no").collect()
    assert (a.provider, a.event_id, a.level, a.message, a.computer) == ("Sec", 4624, "Information", "logged & on", "pc")
    assert (b.event_id, b.level, b.time_created.isoformat(), b.message) == (0, "Verbose", "2024-01-02T00:00:00", None)
    kinds = spark.createDataFrame([("<Subscribe><SubscriptionId>1</SubscriptionId>",), ("<Event>",), ("<Event xmlns='x'>",), ("<Heartbeat/>",)], "b string")
    assert [r[0] for r in kinds.select(windows_events.message_type(F.col("b"))).collect()] == ["Subscription", "Events", "Unknown", "Heartbeat"]


def test_definitions(spark, tmp_path):
    xml = '<Event><EventData><Data Name="TargetUserName">ines</Data><Data Name="TargetDomainName">LAB</Data><Data Name="LogonType">3</Data><Data Name="IpAddress">192.0.2.50</Data><Data Name="IpPort">50123</Data></EventData>'
    rows = spark.createDataFrame([(4624, xml), (4624, xml.replace(">3<", ">x<")), (1, xml)], "event_id int, raw_xml string")
    a, b, c = windows_events.apply_definitions(rows, [windows_events.LOGON]).collect()
    assert a.formatted_message == "User ines from LAB logged on via Network from 192.0.2.50:50123"
    assert a.enrichments == {"LogonType_Name": "Network"} and a.fields["IpPort"] == "50123"
    assert b.fields is None and c.parser_name is None
    (tmp_path / "b.yml").write_text("event_id: 7\nname: second\nfields: [{name: A, source: EventData, required: true, type: boolean}]\n")
    (tmp_path / "a.yaml").write_text("event_id: 7\nname: first\n")
    got = windows_events.load_definitions(spark, str(tmp_path))
    (tmp_path / "all").mkdir()
    (tmp_path / "all/one.yaml").write_text("event_parsers:\n  x: {event_id: 9, name: nine}\n  y: {event_id: 10, name: ten}\n")
    assert sorted(windows_events.load_definitions(spark, str(tmp_path / "all/one.yaml"))) == [9, 10]
    assert got[7].name == "second" and got[7].fields[0].source == "eventdata"


def test_zeek(spark):
    full = {"_path": "conn", "ts": 1700000000.123, "uid": "C1", "id.orig_h": "10.0.0.1", "id.orig_p": 54321, "id.resp_h": "93.184.216.34", "id.resp_p": 80, "proto": "tcp", "service": "http", "duration": 0.254, "orig_bytes": 512, "resp_bytes": 4096, "conn_state": "SF", "history": "Sh", "orig_pkts": 10, "resp_pkts": 15}
    odd = {"_path": "conn", "uid": 42, "ts": 1700000000.0, "orig_bytes": 18446744073709551615, "id.orig_p": 70000, "service": None}
    docs = [json.dumps(full), json.dumps(odd), "NOT VALID JSON", '{"_path":"weird","uid":"C2","x":1}', '{"uid":"C3"}']
    parsed = json_streams.parse_lines(lines(spark, *docs), "_path")
    a, b = json_streams.zeek_table(parsed, "conn").orderBy(F.col("uid").asc_nulls_last()).collect()
    assert (a.ts, a.id_orig_p, a.orig_bytes, a.duration, json.loads(a._extra)) == (1700000000.123, 54321, 512, 0.254, {"_path": "conn"})
    assert b.uid is None and int(b.orig_bytes) == 18446744073709551615 and b.id_orig_p is None
    assert json.loads(b._extra) == {"_path": "conn", "uid": 42, "id.orig_p": 70000, "service": None}
    assert {(r.uid, r.log_path) for r in json_streams.zeek_envelope(parsed).collect()} == {("C2", "weird"), ("C3", "unknown")}
    dns = json_streams.zeek_table(json_streams.parse_lines(lines(spark, '{"_path":"dns","answers":["a"],"trans_id":80.0}'), "_path"), "dns").first()
    assert dns.answers == '["a"]' and dns.trans_id is None
    assert [(r.seq, r.reason) for r in json_streams.rejected_lines(lines(spark, "{}", "{", " ", "1" * 99), max_bytes=50).orderBy("seq").collect()] == [(1, "malformed"), (3, "oversize")]


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t if isinstance(t, bytes) else t.encode(), "dflt") for i, t in enumerate(texts)], "body_id long, body binary, default_sourcetype string")


def test_collector(spark):
    good = '{"event":{"action":"login"},"sourcetype":"audit","host":"srv1","time":1700000000.5}\n\n{"event":null}'
    rows = ingest.hec_events(bodies(spark, good, '{"sourcetype":"t","host":"h"}', "not json", b"\xff", '{"event":1}\n{"no":1}')).orderBy("line_no").collect()
    assert [(r.body_id, r.sourcetype, r.host) for r in rows] == [(0, "audit", "srv1"), (0, "dflt", None)]
    assert rows[0].time.isoformat() == "2023-11-14T22:13:20.500000" and json.loads(rows[0].fields) == {"action": "login"}
    assert [r[0].microsecond for r in spark.sql("select 1700000000.123456D as s").select(ingest.epoch_time(F.col("s"))).collect()] == [123456]
    assert spark.sql("select 1e15D as s").select(ingest.epoch_time(F.col("s"))).first()[0] is None
    assert json.loads(ingest.hec_raw(bodies(spark, "raw log line here")).first().fields) == {"raw": "raw log line here"}
    assert [r.fields for r in ingest.ndjson(bodies(spark, '1\n{"a":2}', "x")).orderBy("line_no").collect()] == ["1", '{"a":2}']


def test_otlp_json_and_protobuf(spark):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def pair(k, v):
        return field(1, k.encode()) + field(2, field(1, v.encode()))

    record = field(6, pair("k", "log")) + field(5, field(1, b"hello")) + field(9, b"\x01\x02") + bytes([2 << 3, 9])
    proto = field(1, field(1, field(1, pair("k", "resource")) + field(1, pair("s", "x"))) + field(2, field(2, record)))
    doc = {"resourceLogs": [{"resource": {"attributes": [{"key": "k", "value": {"stringValue": "resource"}}, {"key": "s", "value": {"stringValue": "x"}}]}, "scopeLogs": [{"logRecords": [{"attributes": [{"key": "k", "value": {"stringValue": "log"}}], "body": {"stringValue": "hello"}, "traceId": "0102", "severityNumber": 9}]}]}]}
    df = spark.createDataFrame([(0, json.dumps(doc).encode(), "application/json", "h"), (1, proto, "application/x-protobuf", "h"), (2, b"{", "application/json", "h")], "body_id long, body binary, content_type string, source_host string")
    rows = ingest.otlp_logs(df).orderBy("body_id").collect()
    want = {"k": "log", "s": "x", "body": "hello", "trace_id": "0102", "severity_number": 9}
    assert [json.loads(r.fields) for r in rows] == [want, want] and rows[0].time is None
    odd = spark.createDataFrame([(0, b"{}", "text/plain"), (1, b"{", "application/json"), (2, b"{}", "application/json; charset=utf-8"), (3, b"\xff", "application/x-protobuf"), (4, b"", None)], "body_id long, body binary, content_type string")
    assert sorted((r.body_id, r.status) for r in ingest.otlp_rejected(odd).collect()) == [(0, 415), (1, 400), (3, 400), (4, 415)]
    assert ingest.any_value({"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"bytesValue": "AQI="}]}}}]}}) == {"a": [1, "0102"]}


def test_stats_and_routing(spark):
    ev = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:01'), ('b', timestamp'2024-01-01 00:03:00'), ('a', timestamp'2024-01-01 00:04:59') as t(event_type, ts)")
    rows = {r.event_type: r for r in stats.snapshot(ev, F.lit("2024-01-01 00:05:00").cast("timestamp")).collect()}
    assert (rows["a"].total_events, rows["a"].last_minute, rows["a"].last_five_minutes) == (2, 0, 1)
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, None)], "seq long, k string")
    assert [r.segment for r in route.cap_partitions(df, "k", "seq", 2).orderBy("seq").collect()] == ["x", "y", "x", "_overflow", "_overflow"]
    wide = ["::1", "0:0:0:0:0:0:0:1", "::ffff:192.0.2.1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "FE80::a%eth0", "::", "12345::", "1:2:3:4:5:6:7::", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in wide], "ip string").select(X.ipv6_hex(F.col("ip"))).collect()]
    assert got == [f"{1:032x}"] * 2 + ["0" * 20 + "ffffc0000201", None, None, None, "fe80" + "0" * 27 + "a", "0" * 32, None, "0001000200030004000500060007" + "0000", None, None]
    ips = spark.createDataFrame([("10.0.0.5",), ("10.0.1.5",), ("::1",), ("nonsense",), ("fd00::9",)], "ip string")
    assert [r[0] for r in ips.select(route.allowed(F.col("ip"), ["10.0.0.0/24", "::1", "fd00::/8"])).collect()] == [True, False, True, False, True]
    names = spark.createDataFrame([("Conn-Log",), ("",), ("x" * 80,)], "k string").select(X.sanitize_segment(F.col("k"))).collect()
    assert [r[0] for r in names] == ["conn_log", "unknown", "x" * 64]

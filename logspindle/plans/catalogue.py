"""Queries over the driver's tables and their SQL.

The tables hold no log records, so raw records are rendered from their columns, run through the operators, and compared
with SQL over the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import counters, flows, ingest, json_streams, netflow5, payload, route, sflow, stats, syslog, windows_events
from ..sources import network

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query of its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            _columns()
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _s(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


_IP_SQL = "'10.' || (user_id % 5) || '.' || ((event_id // 256) % 256) || '.' || (event_id % 256)"
_ISO_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def _lines3164(events: DataFrame) -> DataFrame:
    return events.withColumn("value", _s("<", ID % 192, ">", _STAMP, " host", USER, " ", KIND, "[", ID, "]: value of ", KIND))


def _lines5424(events: DataFrame) -> DataFrame:
    return events.withColumn("value", _s("<", ID % 192, ">1 ", _ISO, "Z host", USER, " ", KIND, " ", ID, " ID", ID % 9, ' [ev@1 user="', USER, '" kind="', KIND, '"] seen ', KIND))


@query("""SELECT event_id, event_id % 192 AS priority, (event_id % 192) % 8 AS severity, (event_id % 192) // 8 AS facility, date_trunc('second', ts) AS timestamp,
  'host' || user_id AS hostname, event_type AS app_name, event_id::VARCHAR AS proc_id, 'value of ' || event_type AS message, 'Rfc3164' AS protocol FROM events""")
def syslog_rfc3164_parse(t):
    out = syslog.parse_syslog(_lines3164(t("events")), year=F.year("ts"))
    return _big(out.select("event_id", "priority", "severity", "facility", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "hostname", "app_name", "proc_id", "message", "protocol"), "priority", "severity", "facility")


@query("""SELECT event_id, event_id % 192 AS priority, (event_id % 192) % 8 AS severity, ts AS timestamp, 'host' || user_id AS hostname, event_type AS app_name,
  event_id::VARCHAR AS proc_id, 'ID' || (event_id % 9) AS msg_id, user_id::VARCHAR AS sd_user, event_type AS sd_kind, 'seen ' || event_type AS message FROM events""")
def syslog_rfc5424_parse(t):
    out = syslog.parse_syslog(_lines5424(t("events")))
    sd = F.col("structured_data")["ev@1"]
    return _big(out.select("event_id", "priority", "severity", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "hostname", "app_name", "proc_id", "msg_id", sd["user"].alias("sd_user"), sd["kind"].alias("sd_kind"), "message"), "priority", "severity")


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'Rfc3164' WHEN 1 THEN 'Rfc5424' ELSE 'none' END AS protocol, count(*) AS n FROM events GROUP BY 1""")
def syslog_parse_chain(t):
    a, b = _lines3164(t("events")).where(ID % 3 == 0), _lines5424(t("events")).where(ID % 3 == 1)
    c = t("events").where(ID % 3 == 2).withColumn("value", _s("no syslog ", ID))
    out = syslog.parse_syslog(a.unionByName(b).unionByName(c))
    return out.groupBy(F.coalesce("protocol", F.lit("none")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""SELECT {_names(X.FACILITIES)}[(event_id % 192) // 8 + 1] AS facility_name, {_names(X.SEVERITIES)}[(event_id % 192) % 8 + 1] AS severity_name, count(*) AS n FROM events GROUP BY 1, 2""")
def syslog_severity_rollup(t):
    out = syslog.parse_syslog(_lines3164(t("events")), year=F.year("ts"))
    return out.groupBy(X.facility_name(F.col("facility")).alias("facility_name"), X.severity_name(F.col("severity")).alias("severity_name")).agg(F.count(F.lit(1)).alias("n"))


def _dns_lines(events: DataFrame) -> DataFrame:
    name = _s(KIND, USER, ".example.com")
    bind = _s("client ", _IP, "#", ID % 60000 + 1024, ": query: ", name, " IN A + (192.0.2.", ID % 250, ")")
    unbound = _s("info: ", _IP, " ", name, ". AAAA IN")
    power = _s("Remote ", _IP, " wants '", name, "|MX'")
    return events.withColumn("message", F.when(ID % 3 == 0, bind).when(ID % 3 == 1, unbound).otherwise(power))


@query(f"""SELECT event_id, {_IP_SQL} AS client_ip, event_type || user_id || '.example.com' AS query_name, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'MX' END AS query_type,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_ips FROM events""")
def dns_query_parse(t):
    out = syslog.parse_dns(_dns_lines(t("events")))
    return out.select("event_id", "dns.client_ip", "dns.query_name", "dns.query_type", F.size("dns.response_ips").cast("bigint").alias("n_ips"))


@query("""SELECT event_type || user_id || '.example.com' AS query_name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, query_name LIMIT 10""")
def dns_top_names(t):
    out = syslog.parse_dns(_dns_lines(t("events")))
    return out.groupBy("dns.query_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query_name").limit(10)


_MAC = "aa:bb:cc:dd:ee:ff"


@query("""SELECT CASE event_id % 8 WHEN 0 THEN 'cef' WHEN 1 THEN 'leef' WHEN 2 THEN 'auditd' WHEN 3 THEN 'dhcp' WHEN 4 THEN 'radius' WHEN 5 THEN 'web_access' WHEN 6 THEN 'dns' ELSE 'none' END AS payload_type, count(*) AS n FROM events GROUP BY 1""")
def payload_dispatch(t):
    dns = _dns_lines(t("events")).withColumnRenamed("message", "q")
    message = F.lit(None).cast("string")
    for i, c in enumerate([_CEF, _LEEF, _AUDIT, _DHCP, _RADIUS, _WEB, F.col("q"), _s("plain ", ID)]):
        message = F.when(ID % 8 == i, c).otherwise(message)
    out = payload.dispatch(dns.withColumn("message", message))
    return out.groupBy(F.coalesce("payload_type", F.lit("none")).alias("payload_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, 0::BIGINT AS version, 'Acme' AS device_vendor, 'SIG' || (event_id % 7) AS signature_id, 'Rule | ' || event_type AS name, (event_id % 10)::VARCHAR AS severity,
  {_IP_SQL} AS src, (event_id % 65536)::VARCHAR AS spt, 'user ' || user_id || ' did ' || event_type AS msg, 'ok' AS act FROM events""")
def cef_parse(t):
    c = t("events").select("event_id", payload.cef(_CEF).alias("c"))
    e = F.col("c.extensions")
    return c.select("event_id", F.col("c.version").cast("bigint").alias("version"), "c.device_vendor", "c.signature_id", "c.name", "c.severity", *[e[k].alias(k) for k in ("src", "spt", "msg", "act")])


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '1.0' ELSE '2.0' END AS leef_version, CASE WHEN event_id % 2 = 1 THEN '^' END AS delimiter, event_type AS kind, {_IP_SQL} AS src, 'u' || user_id AS usr FROM events""")
def leef_parse(t):
    c = t("events").select("event_id", payload.leef(_LEEF).alias("c"))
    return c.select("event_id", "c.leef_version", "c.delimiter", F.col("c.event_id").alias("kind"), F.col("c.attributes")["src"].alias("src"), F.col("c.attributes")["usrName"].alias("usr"))


@query("""SELECT event_id, 'SYSCALL' AS record_type, '1700000000.' || (event_id % 1000) || ':' || event_id AS audit_id, event_type AS comm, (event_id % 300)::VARCHAR AS syscall, user_id::VARCHAR AS uid FROM events""")
def auditd_parse(t):
    c = t("events").select("event_id", payload.auditd(_AUDIT).alias("c"))
    return c.select("event_id", "c.record_type", "c.audit_id", *[F.col("c.fields")[k].alias(k) for k in ("comm", "syscall", "uid")])


@query(f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'DHCPACK' WHEN 1 THEN 'DHCPREQUEST' ELSE 'DHCPDISCOVER' END AS message_type, CASE WHEN event_id % 3 < 2 THEN {_IP_SQL} END AS ip, '{_MAC}' AS mac,
  CASE WHEN event_id % 3 = 0 THEN 'h' || user_id END AS hostname, CASE event_id % 3 WHEN 0 THEN 'eth0' WHEN 1 THEN 'eth1' END AS interface FROM events""")
def dhcp_parse(t):
    return t("events").select("event_id", payload.dhcp(_DHCP).alias("c")).select("event_id", "c.message_type", "c.ip", "c.mac", "c.hostname", "c.interface")


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'fail' END AS outcome, CASE WHEN event_id % 2 = 1 THEN 'PAP' END AS method, 'u' || user_id AS username, (event_id % 100)::VARCHAR AS port, CASE WHEN event_id % 2 = 0 THEN {_IP_SQL} END AS client_ip FROM events""")
def radius_parse(t):
    return t("events").select("event_id", payload.radius(_RADIUS).alias("c")).select("event_id", "c.outcome", "c.method", "c.username", "c.port", "c.client_ip")


@query("""SELECT 'u' || user_id AS username, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1 ORDER BY n DESC, username LIMIT 20""")
def failed_logons_by_user(t):
    c = t("events").select(payload.radius(_RADIUS).alias("c")).where(F.col("c.outcome") == "fail")
    return c.groupBy("c.username").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "username").limit(20)


@query(f"""SELECT event_id, {_IP_SQL} AS client_ip, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END AS authuser, '/' || event_type AS path, CASE WHEN event_id % 10 = 0 THEN 404 ELSE 200 END::BIGINT AS status, event_id AS bytes FROM events""")
def web_access_parse(t):
    c = t("events").select("event_id", payload.web_access(_WEB).alias("c"))
    return c.select("event_id", "c.client_ip", "c.authuser", "c.path", F.col("c.status").cast("bigint").alias("status"), "c.bytes")


def _event_xml() -> Column:
    return _s("<Event><System><Provider>P", USER % 3, "</Provider><EventID>", ID % 5000, "</EventID><Level>", ID % 6, "</Level><TimeCreated SystemTime='", _ISO, "Z'/><Computer>pc", USER, "</Computer></System><EventData><Data Name=\"k\">event &lt;", ID, "&gt;</Data></EventData></Event>")


@query("""SELECT 'P' || (user_id % 3) AS provider, event_id % 5000 AS event_id, CASE event_id % 6 WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' ELSE 'Verbose' END AS level,
  ts AS time_created, 'pc' || user_id AS computer, 'event <' || event_id || '>' AS message FROM events""")
def wef_event_parse(t):
    bodies = t("events").groupBy("user_id", F.floor(ID / 500)).agg(F.concat(F.lit("<Envelope><Body><Events>"), F.array_join(F.collect_list(_event_xml()), "\n"), F.lit("</Events></Body></Envelope>")).alias("body"))
    bodies = bodies.where(windows_events.message_type(F.col("body")) == "Events")
    out = windows_events.extract_fields(windows_events.split_events(bodies))
    return out.select("provider", F.col("event_id").cast("bigint").alias("event_id"), "level", F.col("time_created").cast("timestamp_ntz").alias("time_created"), "computer", "message")


_LOGONS = windows_events.LOGON.enrichments["LogonType"]


@query(f"""SELECT event_id, user_id::VARCHAR AS logon_user, (event_id % 12)::VARCHAR AS logon_type, CASE event_id % 12 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _LOGONS.items())} END AS logon_name,
  'User ' || user_id || ' from D' || (user_id % 4) || ' logged on via ' || coalesce(CASE event_id % 12 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _LOGONS.items())} END, '{{LogonType_Name}}') || ' from ' || {_IP_SQL} || ':' || (event_id % 65536) AS text FROM events""")
def event_definition_4624(t):
    data = lambda k, v: _s(f'<Data Name="{k}">', v, "</Data>")
    xml = F.concat(F.lit("<Event><System><EventID>4624</EventID></System><EventData>"), data("TargetUserName", USER), data("TargetDomainName", _s("D", USER % 4)), data("LogonType", ID % 12), data("IpAddress", _IP), data("IpPort", ID % 65536), F.lit("</EventData>"))
    rows = t("events").select(ID.alias("row"), F.lit(4624).alias("event_id"), xml.alias("raw_xml"))
    out = windows_events.apply_definitions(rows, [windows_events.LOGON])
    return out.select(F.col("row").alias("event_id"), F.col("fields")["TargetUserName"].alias("logon_user"), F.col("fields")["LogonType"].alias("logon_type"), F.col("enrichments")["LogonType_Name"].alias("logon_name"), F.col("formatted_message").alias("text"))


def _zeek_lines(events: DataFrame) -> DataFrame:
    port = F.when(ID % 7 == 0, _s('"', ID % 65536, '"')).otherwise(_s(ID % 65536))
    line = _s('{"_path":"', F.when(ID % 5 == 0, "weird").otherwise("conn"), '","uid":"C', ID, '","id.orig_h":"', _IP, '","id.orig_p":', port, ',"proto":"tcp","orig_bytes":', ID * 3, ',"resp_bytes":', ID, '.0,"note":"n', USER, '"}')
    return events.select("event_id", F.when(ID % 11 == 0, "NOT JSON").otherwise(line).alias("value"))


@query(f"""SELECT 'C' || event_id AS uid, {_IP_SQL} AS id_orig_h, CASE WHEN event_id % 7 <> 0 THEN event_id % 65536 END AS id_orig_p, event_id * 3 AS orig_bytes FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0""")
def zeek_conn_typed(t):
    out = json_streams.zeek_table(json_streams.parse_lines(_zeek_lines(t("events")), "_path"), "conn")
    return _big(out.select("uid", "id_orig_h", "id_orig_p", "orig_bytes"), "id_orig_p", "orig_bytes")


@query("""SELECT 'C' || event_id AS uid, CASE WHEN event_id % 7 = 0 THEN (event_id % 65536)::VARCHAR END AS extra_port, 'n' || user_id AS extra_note, 'conn' AS extra_path FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0""")
def zeek_type_mismatch(t):
    out = json_streams.zeek_table(json_streams.parse_lines(_zeek_lines(t("events")), "_path"), "conn")
    extra = lambda k: F.get_json_object("_extra", f"$['{k}']")
    return out.select("uid", extra("id.orig_p").alias("extra_port"), extra("note").alias("extra_note"), extra("_path").alias("extra_path"))


@query("""SELECT 'C' || event_id AS uid, 'weird' AS log_path, 'n' || user_id AS note FROM events WHERE event_id % 5 = 0 AND event_id % 11 <> 0""")
def zeek_envelope(t):
    out = json_streams.zeek_envelope(json_streams.parse_lines(_zeek_lines(t("events")), "_path"))
    return out.select("uid", "log_path", F.get_json_object("payload", "$.note").alias("note"))


@query(f"""SELECT event_type, CASE WHEN event_id % 4 <> 0 THEN {_IP_SQL} END AS src_ip, count(*) AS n FROM events GROUP BY 1, 2""")
def suricata_envelope(t):
    line = _s('{"event_type":"', KIND, '","src_ip":', F.when(ID % 4 == 0, "null").otherwise(_s('"', _IP, '"')), "}")
    out = json_streams.suricata_table(json_streams.parse_lines(t("events").select(line.alias("value")), "event_type"))
    return out.groupBy("event_type", "src_ip").agg(F.count(F.lit(1)).alias("n"))


def _bodies(events: DataFrame, poison: bool, line: Column) -> DataFrame:
    spoiled = F.when((F.floor(ID / 5) % 7 == 0) & (ID % 5 == 4), F.lit('{"nope":') if poison else line).otherwise(line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ID, spoiled.alias("l")))), lambda x: x["l"]), "\n")
    return events.groupBy(F.floor(ID / 5).alias("body_id")).agg(F.encode(joined, "UTF-8").alias("body")).withColumn("default_sourcetype", F.lit("web"))




@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'web' ELSE event_type END AS sourcetype, 'h' || user_id AS host, make_timestamp((1700000000 + event_id) * 1000000 + 500000) AS time, event_id::VARCHAR AS field_id, event_type AS field_kind FROM events""")
def hec_event_parse(t):
    out = ingest.hec_events(_bodies(t("events"), False, _HEC))
    return out.select("sourcetype", "host", F.col("time").cast("timestamp_ntz").alias("time"), F.get_json_object("fields", "$.id").alias("field_id"), F.get_json_object("fields", "$.kind").alias("field_kind"))


@query("""SELECT event_id // 5 AS body_id, count(*) AS n FROM events WHERE event_id // 5 NOT IN (SELECT event_id // 5 FROM events WHERE (event_id // 5) % 7 = 0 AND event_id % 5 = 4) GROUP BY 1""")
def hec_body_atomicity(t):
    return ingest.hec_events(_bodies(t("events"), True, _HEC)).groupBy("body_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'web' AS sourcetype, event_id AS id, event_type AS kind FROM events""")
def ndjson_parse(t):
    out = ingest.ndjson(_bodies(t("events"), False, _s('{"id":', ID, ',"kind":"', KIND, '"}')))
    return out.select("sourcetype", F.get_json_object("fields", "$.id").cast("bigint").alias("id"), F.get_json_object("fields", "$.kind").alias("kind"))


@query("""SELECT event_id AS body_id, 'otlp' AS sourcetype, 'peer' || user_id AS host, ts AS time, 'log' AS k, 'svc' || (user_id % 5) AS service, event_id::VARCHAR AS n, event_type AS body, 'WARN' AS severity FROM events""")
def otlp_flatten(t):
    kv = lambda k, v: _s('{"key":"', k, '","value":{', v, "}}")
    nanos = _s(F.unix_micros(TS.cast("timestamp")), "000")
    body = _s(
        '{"resourceLogs":[{"resource":{"attributes":[', kv("service", _s('"stringValue":"svc', USER % 5, '"')), ",", kv("k", F.lit('"stringValue":"resource"')), ']},"scopeLogs":[{"scope":{"attributes":[', kv("k", F.lit('"stringValue":"scope"')),
        ']},"logRecords":[{"timeUnixNano":"', nanos, '","severityText":"WARN","body":{"stringValue":"', KIND, '"},"attributes":[', kv("k", F.lit('"stringValue":"log"')), ",", kv("n", _s('"intValue":"', ID, '"')), "]}]}]}]}",
    )
    rows = t("events").select(ID.alias("body_id"), F.encode(body, "UTF-8").alias("body"), F.lit("application/json").alias("content_type"), _s("peer", USER).alias("source_host"))
    f = lambda k, name=None: F.get_json_object("fields", f"$.{k}").alias(name or k)
    return ingest.otlp_logs(rows).select("body_id", "sourcetype", "host", F.col("time").cast("timestamp_ntz").alias("time"), f("k"), f("service"), f("n"), f("body"), f("severity_text", "severity"))


def _h(c, size: int) -> Column:
    """``size`` bytes of a number as hex text."""
    return F.lpad(F.hex(c if isinstance(c, Column) else F.lit(c)), 2 * size, "0")


_DST_SQL = "'192.0.2.' || (event_id % 256)"


@query(f"""SELECT event_id AS seq, {_IP_SQL} AS src_addr, {_DST_SQL} AS dst_addr, event_id % 65536 AS src_port, 443::BIGINT AS dst_port, 6::BIGINT AS ip_protocol, event_id * 100 AS octets, user_id AS packets, 24::BIGINT AS tcp_flags FROM events""")
def netflow_v5_decode(t):
    head = F.concat(F.lit("00050001"), _h(0, 4), _h(1700000000, 4), _h(0, 12))
    rec = F.concat(_SRC, _DST, _h(0, 4), _h(1, 2), _h(2, 2), _h(USER, 4), _h(ID * 100, 4), _h(7, 4), _h(9, 4), _h(ID % 65536, 2), _h(443, 2), F.lit("00"), _h(24, 1), _h(6, 1), F.lit("00"), _h(0, 8))
    out = netflow5.decode_netflow_v5(t("events").select(ID.alias("seq"), F.lit("e").alias("exporter"), F.unhex(F.concat(head, rec)).alias("payload")))
    out = out.select("seq", "src_addr", "dst_addr", "src_port", "dst_port", "ip_protocol", F.col("octet_delta_count").alias("octets"), F.col("packet_delta_count").alias("packets"), "tcp_flags")
    return _big(out, "src_port", "dst_port", "ip_protocol", "octets", "packets", "tcp_flags")


_FIELDS = "00080004000C000400070002000B0002000400010001000800020008"


def _ipfix(events: DataFrame) -> DataFrame:
    """Exporters 0 to 5 announce their template in a datagram of their own, exporter 6 never."""
    exporter = _s("e", ID % 7)
    wrap = lambda sets, size: F.concat(F.lit("000A"), _h(16 + size, 2), _h(1700000000, 4), _h(0, 4), _h(1, 4), sets)
    data = events.select(ID + 1, exporter, F.unhex(wrap(F.concat(_h(256, 2), _h(33, 2), _RECORD), 33)))
    told = events.select((ID % 7).alias("e")).distinct().where("e < 6")
    told = told.select(F.lit(-1).cast("bigint"), _s("e", F.col("e")), F.unhex(wrap(F.lit("0002002401000007" + _FIELDS), 36)))
    return data.union(told).toDF("seq", "exporter", "payload")


def _flow_columns(out: DataFrame) -> DataFrame:
    out = out.select("exporter", "protocol_version", "src_addr", "dst_addr", "src_port", "dst_port", "ip_protocol", F.col("octet_delta_count").alias("octets"), F.col("packet_delta_count").alias("packets"))
    return _big(out, "protocol_version", "src_port", "dst_port", "ip_protocol", "octets", "packets")


_FLOW_SQL = f"""'e' || (event_id % 7) AS exporter, {{v}}::BIGINT AS protocol_version, {_IP_SQL} AS src_addr, {_DST_SQL} AS dst_addr, event_id % 65536 AS src_port, 80::BIGINT AS dst_port, 17::BIGINT AS ip_protocol, event_id * 10 AS octets, user_id AS packets"""


@query("SELECT " + _FLOW_SQL.format(v=10) + " FROM events WHERE event_id % 7 < 6")
def ipfix_decode(t):
    return _flow_columns(flows.decode_flows(_ipfix(t("events"))))


@query("""SELECT 'e6' AS exporter, 1::BIGINT AS domain, 256::BIGINT AS template_id, count(*) AS n_sets FROM events WHERE event_id % 7 = 6 HAVING count(*) > 0""")
def ipfix_missing_template(t):
    return _big(flows.missing_templates(_ipfix(t("events"))), "template_id")


@query("SELECT " + _FLOW_SQL.format(v=9) + " FROM events")
def netflow_v9_decode(t):
    """Each datagram brings its own template."""
    body = F.concat(F.lit("00090002"), _h(0, 4), _h(1700000000, 4), _h(0, 4), _h(5, 4), F.lit("0000002401000007" + _FIELDS), _h(256, 2), _h(33, 2), _RECORD)
    return _flow_columns(flows.decode_flows(t("events").select(ID.alias("seq"), _s("e", ID % 7).alias("exporter"), F.unhex(body).alias("payload"))))


def _sflow(sample: Column) -> Column:
    return F.concat(_h(5, 4), _h(1, 4), F.lit("0A000001"), _h(0, 4), _h(1, 4), _h(1, 4), _h(1, 4), sample)


@query(f"""SELECT event_id AS seq, '10.0.0.1' AS exporter, {_IP_SQL} AS src_addr, {_DST_SQL} AS dst_addr, event_id % 65536 AS src_port, 53::BIGINT AS dst_port, 17::BIGINT AS ip_protocol, 512::BIGINT AS sampling_rate, user_id AS input_ifindex FROM events""")
def sflow_flow_decode(t):
    item = F.concat(_h(60, 4), _h(17, 4), _SRC, _DST, _h(ID % 65536, 4), _h(53, 4), _h(0, 4), _h(0, 4))
    sample = F.concat(_h(1, 4), _h(72, 4), _h(1, 4), _h(0, 4), _h(512, 4), _h(0, 4), _h(0, 4), _h(USER, 4), _h(2, 4), _h(1, 4), _h(3, 4), _h(32, 4), item)
    out = sflow.flow_table(sflow.decode_sflow(t("events").select(ID.alias("seq"), F.unhex(_sflow(sample)).alias("payload"))))
    return out.select("seq", "exporter", "src_addr", "dst_addr", "src_port", "dst_port", "ip_protocol", "sampling_rate", "input_ifindex")


@query("""SELECT event_id AS seq, user_id AS if_index, 6::BIGINT AS if_type, event_id * 1000 AS in_octets, event_id AS out_octets, event_id % 17 AS in_errors FROM events""")
def sflow_counter_decode(t):
    item = F.concat(_h(USER, 4), _h(6, 4), _h(1000000000, 8), _h(1, 4), _h(3, 4), _h(ID * 1000, 8), _h(1, 4), _h(0, 4), _h(0, 4), _h(0, 4), _h(ID % 17, 4), _h(0, 4), _h(ID, 8), _h(1, 4), _h(0, 4), _h(0, 4), _h(0, 4), _h(0, 4), _h(0, 4))
    sample = F.concat(_h(2, 4), _h(108, 4), _h(1, 4), _h(0, 4), _h(1, 4), _h(1, 4), _h(88, 4), item)
    out = sflow.counter_table(sflow.decode_sflow(t("events").select(ID.alias("seq"), F.unhex(_sflow(sample)).alias("payload"))))
    return _big(out.select("seq", "if_index", "if_type", F.col("if_in_octets").alias("in_octets"), F.col("if_out_octets").alias("out_octets"), F.col("if_in_errors").alias("in_errors")), "in_octets", "out_octets")


@query(f"""SELECT {_IP_SQL} AS src_addr, sum(event_id * 100)::BIGINT AS octets FROM events GROUP BY 1 ORDER BY octets DESC, src_addr LIMIT 20""")
def top_talkers(t):
    flows_ = netflow_v5_decode(t)
    return flows_.groupBy("src_addr").agg(F.sum("octets").alias("octets")).orderBy(F.desc("octets"), "src_addr").limit(20)


_AS_OF = "(SELECT max(epoch_us(ts)) // 60000000 AS m FROM events)"
_MINUTE = "epoch_us(ts) // 60000000"


@query(f"""SELECT event_type, count(*) AS total_events, count(*) FILTER ({_MINUTE} = m) AS last_minute, count(*) FILTER ({_MINUTE} > m - 5) AS last_five_minutes, count(*) FILTER ({_MINUTE} = m) / 60.0::DOUBLE AS average_per_second_last_minute FROM events, {_AS_OF} GROUP BY 1""")
def throughput_snapshot(t):
    now = t("events").agg(F.max("ts").alias("now"))
    return stats.snapshot(t("events").join(F.broadcast(now)), F.col("now"))  # one row


@query(f"""SELECT event_type, {_MINUTE} AS minute, count(*) AS n FROM events GROUP BY 1, 2""")
def throughput_series(t):
    return stats.series(t("events"))


@query(f"""SELECT event_type, minute, n, (sum(n) OVER (PARTITION BY event_type ORDER BY minute RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))::BIGINT AS n_window FROM (SELECT event_type, {_MINUTE} AS minute, count(*) AS n FROM events GROUP BY 1, 2)""")
def throughput_sliding5(t):
    return stats.sliding(stats.series(t("events")))


@query(f"""SELECT event_type, {_MINUTE} AS minute, count(*) AS n FROM events, {_AS_OF} WHERE {_MINUTE} >= m - 60 GROUP BY 1, 2""")
def retention_60m(t):
    last = t("events").agg(stats.minute_of(F.max("ts")).alias("m"))
    return stats.retained(stats.series(t("events")).join(F.broadcast(last)), F.col("m")).drop("m")


@query("""SELECT CASE WHEN s = '' THEN 'unknown' ELSE s END AS segment, count(*) AS n FROM (SELECT left(regexp_replace(lower(url), '[^a-z0-9_]', '_', 'g'), 64) AS s FROM pages) GROUP BY 1""")
def route_sanitize(t):
    return t("pages").groupBy(X.sanitize_segment(F.col("url")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), k AS (SELECT user_id, row_number() OVER (ORDER BY first, user_id) AS r FROM f)
  SELECT CASE WHEN r <= 16 THEN user_id::VARCHAR ELSE '_overflow' END AS segment, count(*) AS n FROM events JOIN k USING (user_id) GROUP BY 1""")
def overflow_cap(t):
    out = route.cap_partitions(t("events").withColumn("user_id", USER.cast("string")), "user_id", "event_id", 16)
    return out.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100""")
def drop_oldest_cap(t):
    return route.drop_oldest(t("events"), "event_type", "event_id", 100).select("event_id", "event_type")


@query("""SELECT c_custkey % 4 = 1 OR (c_custkey % 4 = 2 AND c_custkey % 256 < 128) AS allowed, count(*) AS n FROM customer GROUP BY 1""")
def cidr_allowlist(t):
    key = F.col("c_custkey")
    ip = _s("10.", key % 4, ".7.", key % 256)
    return t("customer").groupBy(route.allowed(ip, ["10.1.0.0/16", "10.2.7.0/25"]).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, '<' || (128 + CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 7 END) || '>1 ' || {_ISO_SQL} || 'Z host' || user_id || ' WEF - - [' || event_id || '] <E> ' || event_type || '</E>' AS line FROM events""")
def rfc5424_format(t):
    level = F.element_at(F.array(*map(F.lit, ["Critical", "Error", "Warning", "Information", "Verbose"])), (ID % 5 + 1).cast("int"))
    return t("events").select("event_id", route.rfc5424_line(level, F.concat(_ISO, F.lit("Z")), _s("host", USER), ID.cast("string"), _s("<E>\n", KIND, "\r</E>")).alias("line"))


@query("""SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def partition_date_layout(t):
    return route.with_date(t("events"), TS).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, 'P' || (user_id % 3) || ':' || event_id AS label FROM events WHERE user_id % 3 > 0 UNION ALL SELECT event_id, 'EventID ' || event_id FROM events WHERE user_id % 3 = 0""")
def event_type_label(t):
    provider = F.when(USER % 3 == 0, "").otherwise(_s("P", USER % 3))
    return t("events").select("event_id", windows_events.event_label(provider, ID).alias("label"))


@query("""SELECT event_type AS kind, 'events_received' AS metric, count(*) AS value FROM events GROUP BY 1""")
def metric_counters(t):
    return stats.counters(t("events").withColumnRenamed("event_type", "kind"), "events_received", "kind")


@query("""WITH e AS (SELECT event_id % 4 AS a, event_id % 5 AS b, event_id % 3 AS c, event_type FROM events)
  SELECT 'syslog_messages_received' AS metric, NULL AS label, count(*) AS value FROM e WHERE a <> 3
  UNION ALL SELECT 'syslog_oversized_lines', NULL, count(*) FROM e WHERE a = 3
  UNION ALL SELECT 'syslog_parse_errors', NULL, count(*) FROM e WHERE a = 0
  UNION ALL SELECT 'syslog_payload_parsed', CASE a WHEN 1 THEN 'cef' ELSE 'radius' END, count(*) FROM e WHERE a IN (1, 2) GROUP BY 2
  UNION ALL SELECT s || '_oversized_lines', NULL, count(*) FROM e, (VALUES ('zeek'), ('suricata')) AS v(s) WHERE b = 0 GROUP BY s
  UNION ALL SELECT s || '_parse_errors', NULL, count(*) FROM e, (VALUES ('zeek'), ('suricata')) AS v(s) WHERE b = 1 GROUP BY s
  UNION ALL SELECT s || '_records_received', NULL, count(*) FROM e, (VALUES ('zeek'), ('suricata')) AS v(s) WHERE b > 1 GROUP BY s
  UNION ALL SELECT m, NULL, count(*) FROM e, (VALUES ('zeek_missing_path'), ('suricata_missing_event_type')) AS v(m) WHERE b = 2 GROUP BY m
  UNION ALL SELECT m, CASE b WHEN 2 THEN 'unknown' ELSE event_type END AS label, count(*)
    FROM e, (VALUES ('zeek_records_by_path'), ('suricata_records_by_event_type')) AS v(m) WHERE b > 1 GROUP BY m, 2
  UNION ALL SELECT 'hec_events_received', NULL, 2 * count(*) FROM e WHERE c > 0
  UNION ALL SELECT 'hec_parse_errors', NULL, count(*) FROM e WHERE c = 0""")
def input_counters(t):
    events = t("events")
    head = F.lit("<34>Mar  3 04:05:06 h fw: ")
    line = F.when(ID % 4 == 0, "noise").when(ID % 4 == 1, _s(head, _CEF)).when(ID % 4 == 2, _s(head, "Login OK: [u", USER, "] (from client vpn port 1)")).otherwise(_s(head, F.repeat(F.lit("x"), 400)))
    row = lambda key: F.when(ID % 5 == 0, _s('{"a":"', F.repeat(F.lit("x"), 90), '"}')).when(ID % 5 == 1, "{").when(ID % 5 == 2, _s('{"a":', ID, "}")).otherwise(_s(f'{{"{key}":"', KIND, '"}'))
    body = F.when(ID % 3 == 0, _s('{"event":', ID, '}\n{"events":1}')).otherwise(_s('{"event":', ID, '}\n\n{"event":null}'))
    return counters.together(
        counters.syslog_counters(events.select(line.alias("value")), year=2024, max_bytes=400),
        *[counters.stream_counters(events.select(row(key).alias("value")), name, max_bytes=80) for name, (key, _, _) in counters.STREAMS.items()],
        counters.hec_counters(events.select(ID.alias("body_id"), body.cast("binary").alias("body"), F.lit("d").alias("default_sourcetype"))),
    )


@query("""SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def latest_entries(t):
    return stats.latest(t("events"), 50, "ts", "event_id").select("event_id", "user_id", "ts")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def rate_limit(t):
    return stats.fixed_window_limit(t("events"), key="user_id", ties=("event_id",), seconds=3600, most=1).select("event_id", "allowed")


@query("""WITH RECURSIVE s AS (
  SELECT user_id, min(ts) AS start FROM events GROUP BY 1
  UNION ALL SELECT e.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts > s.start + INTERVAL 1 DAY GROUP BY 1)
  SELECT event_id, row_number() OVER (PARTITION BY e.user_id, s.start ORDER BY ts, event_id) <= 2 AS allowed
  FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.start""")
def rate_limit_anchored(t):
    return stats.anchored_window_limit(t("events"), key="user_id", ties=("event_id",), seconds=86400, most=2).select("event_id", "allowed")


@query("""SELECT key, CASE key WHEN 'k' THEN 'unchanged' WHEN 'n' THEN CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END WHEN 'x' THEN 'removed' ELSE 'added' END AS status, count(*) AS n
  FROM customer, (VALUES ('k'), ('n'), ('x'), ('y')) AS v(key) GROUP BY 1, 2""")
def config_diff(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    old, new = _s('{"k":{"a":', key, '},"n":', nation, ',"x":true}'), _s('{"y":null,"n":', F.when(key % 3 == 0, nation + 1).otherwise(nation), ',"k":{"a":', key, "}}")
    one = t("customer").select(F.explode(json_streams.diff(old, new)).alias("d"))
    return one.groupBy("d.key", "d.status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n_events, count(DISTINCT event_type) AS n_types, count(DISTINCT user_id) AS n_users FROM events""")
def ingest_totals(t):
    return stats.totals(t("events").select(KIND.alias("type"), USER.alias("user")), "type", "user")


@query(f"""SELECT event_id % 192 AS priority, 'gw' || user_id AS hostname, CASE WHEN event_id % 3 = 0 THEN 'cef' ELSE 'radius' END AS payload_type, CASE WHEN event_id % 3 = 0 THEN {_IP_SQL} ELSE 'u' || user_id END AS who FROM events WHERE event_id % 3 < 2""")
def structured_payloads(t):
    message = F.when(ID % 3 == 0, _CEF).when(ID % 3 == 1, _RADIUS).otherwise(_s("plain ", ID))
    lines = t("events").withColumn("value", _s("<", ID % 192, ">", _STAMP, " gw", USER, " agent[1]: ", message))
    out = payload.structured_records(syslog.parse_syslog(lines, year=F.year("ts")), F.lit(None).cast("timestamp"))
    who = F.coalesce(F.get_json_object("parsed", "$.extensions.src"), F.get_json_object("parsed", "$.username"))
    return out.select(F.col("priority").cast("bigint").alias("priority"), "hostname", "payload_type", who.alias("who"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fresh' ELSE 'sub-' || event_id END AS subscription_id, '*[' || event_type || ']' AS query, CASE WHEN event_id % 3 > 0 THEN user_id END AS heartbeat_interval FROM events""")
def wef_subscription(t):
    body = _s("<Subscribe>", F.when(ID % 4 == 0, "").otherwise(_s("<SubscriptionId>sub-", ID, "</SubscriptionId>")), "<Query Id='1'>*[", KIND, "]</Query><HeartbeatInterval>", F.when(ID % 3 == 0, "often").otherwise(USER.cast("string")), "</HeartbeatInterval></Subscribe>")
    return t("events").select("event_id", windows_events.subscription(body, F.lit("fresh")).alias("s")).select("event_id", "s.*")


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'Subscription' WHEN 1 THEN 'Heartbeat' WHEN 2 THEN 'Events' ELSE 'Unknown' END AS kind, CASE event_id % 5 WHEN 1 THEN 'hb' || (user_id % 3) ELSE '' END AS subscription_id, count(*) AS n FROM events GROUP BY 1, 2""")
def wef_message_kinds(t):
    body = F.when(ID % 5 == 0, F.lit("<Subscribe><Query/></Subscribe><x>SubscriptionId</x>")).when(ID % 5 == 1, _s("<Heartbeat><SubscriptionId>hb", USER % 3, "</SubscriptionId></Heartbeat>")).when(ID % 5 == 2, F.lit("<Events></Events>"))
    body = F.coalesce(body, F.when(ID % 5 == 3, "<Event xmlns='u'>").otherwise(""))
    rows = t("events").select(windows_events.message_type(body).alias("kind"), body.alias("body"))
    beat = F.when(F.col("kind") == "Heartbeat", windows_events.heartbeat(F.col("body"))["subscription_id"]).otherwise("")
    return rows.select("kind", beat.alias("subscription_id")).groupBy("kind", "subscription_id").agg(F.count(F.lit(1)).alias("n"))


def _definitions() -> list:
    """Three definitions with every field type and source, required and free fields, and a lookup."""
    of = windows_events.EventDefinition.of
    return [
        of({"event_id": 1, "name": "typed", "fields": [{"name": "Count", "type": "integer", "required": True}, {"name": "Flag", "type": "boolean"}, {"name": "Note"}], "enrichments": [{"field": "Count", "lookup_table": {"0": "none", "1": "one"}}], "output_format": "{Count}/{Count_Name}/{Flag}/{Missing}"}),
        of({"event_id": 2, "name": "system", "fields": [{"name": "Computer", "source": "System", "required": True}]}),
        of({"event_id": 3, "name": "rendered", "fields": [{"name": "Message", "source": "RenderingInfo"}], "output_format": "<{Message}>"}),
    ]


@query("""WITH e AS (SELECT event_id, event_id % 4 AS k, user_id, event_type FROM events)
  SELECT event_id, CASE k WHEN 1 THEN 'typed' WHEN 2 THEN 'system' WHEN 3 THEN 'rendered' END AS parser, CASE WHEN k = 1 THEN (event_id // 4 % 3)::VARCHAR END AS number, CASE WHEN k = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END END AS flag,
  CASE k WHEN 1 THEN (event_id // 4 % 3) || '/' || CASE event_id // 4 % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE '{Count_Name}' END || '/' || (user_id % 2 = 0) || '/{Missing}' WHEN 3 THEN '<' || event_type || '>' END AS text
  FROM e WHERE NOT (k = 1 AND user_id % 7 = 0) UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM e WHERE k = 1 AND user_id % 7 = 0""")
def event_definitions_typed(t):
    data = lambda k, v: _s(f'<Data Name="{k}">', v, "</Data>")
    count = F.when(USER % 7 == 0, "many").otherwise(_s(F.floor(ID / 4) % 3))
    xml = _s("<Event><System><Computer>pc</Computer></System><EventData>", data("Count", count), data("Flag", F.when(USER % 2 == 0, "TRUE").otherwise("no")), "</EventData><RenderingInfo><Message> ", KIND, " </Message></RenderingInfo>")
    rows = t("events").select(ID.alias("row"), (ID % 4).cast("int").alias("event_id"), xml.alias("raw_xml"))
    out = windows_events.apply_definitions(rows, _definitions())
    return out.select(F.col("row").alias("event_id"), F.col("parser_name").alias("parser"), F.col("fields")["Count"].alias("number"), F.col("fields")["Flag"].alias("flag"), F.col("formatted_message").alias("text"))


@query("""SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false)) AS v(event_id, known)""")
def supported_event_ids(t):
    known = windows_events.supported_events({d.event_id: d for d in _definitions()})
    return t("region").sparkSession.range(1, 5).select(F.col("id").cast("int").alias("event_id"), F.col("id").isin(known).alias("known"))


@query("""SELECT event_id FROM events WHERE event_id % 6 <> 0""")
def wef_unparsed_left_out(t):
    rows = t("events").select(F.when(ID % 6 != 0, ID).alias("event_id"), TS.alias("time_created"), F.lit("h").alias("source_host"), F.lit("s").alias("subscription_id"), F.lit("<Event>").alias("raw_xml"), *[F.lit("").alias(c) for c in ("provider", "level", "computer", "message")])
    return windows_events.to_table(rows).select("event_id")


@query(f"""SELECT event_id AS seq, 2::BIGINT AS template_id, {_IP_SQL} AS src_addr, user_id AS scope FROM events""")
def ipfix_options_template(t):
    """An options template (set 3) whose data sets carry an address and, as a field that has no column, the flow id."""
    options = F.concat(F.lit("00030016"), _h(300, 2), _h(2, 2), _h(1, 2), F.lit("0094000800080004"), F.lit("00000000"))
    data = F.concat(_h(300, 2), _h(16, 2), _h(USER, 8), _SRC)
    body = F.concat(F.lit("000A"), _h(16 + 22 + 16, 2), _h(1700000000, 4), _h(0, 4), _h(1, 4), options, data)
    out = flows.decode_flows(t("events").select(ID.alias("seq"), F.lit("e").alias("exporter"), F.unhex(body).alias("payload")))
    return out.select("seq", (F.col("template_id") - 298).cast("bigint").alias("template_id"), "src_addr", F.get_json_object("extra", "$.flowId").cast("bigint").alias("scope"))


@query("""SELECT event_id AS seq, 443::BIGINT AS dst_port, (event_id % 256)::BIGINT AS nat_port, '2001:db8::' || lower(printf('%x', (event_id % 65535 + 1)::BIGINT)) AS v6, printf('%04x', (user_id % 65536)::BIGINT) AS own, make_timestamp(1700000000000000 + event_id * 1000) AS flow_start FROM events""")
def ipfix_elements(t):
    """IPv6, translated ports, an enterprise's element and milliseconds."""
    fields = F.concat(F.lit("001B0010"), F.lit("000B0002"), F.lit("00E30002"), F.lit("00980008"), F.lit("80070002"), _h(9, 4))
    template = F.concat(F.lit("0002"), _h(4 + 4 + 24, 2), _h(256, 2), _h(5, 2), fields)
    v6 = F.concat(F.lit("20010DB8"), _h(0, 10), _h(ID % 65535 + 1, 2))
    data = F.concat(_h(256, 2), _h(4 + 30, 2), v6, _h(443, 2), _h(ID % 256, 2), _h(F.lit(1700000000000) + ID, 8), _h(USER % 65536, 2))
    body = F.concat(F.lit("000A"), _h(16 + 32 + 34, 2), _h(1700000000, 4), _h(0, 4), _h(1, 4), template, data)
    out = flows.decode_flows(t("events").select(ID.alias("seq"), F.lit("e").alias("exporter"), F.unhex(body).alias("payload")))
    extra = lambda k: F.get_json_object("extra", f"$['{k}']")
    out = out.select("seq", "dst_port", F.col("src_port").alias("nat_port"), extra("sourceIPv6Address").alias("v6"), extra("ie9:7").alias("own"), F.col("flow_start").cast("timestamp_ntz").alias("flow_start"))
    return _big(out, "dst_port", "nat_port")


@query("""SELECT 'e' || (event_id % 3) AS exporter, count(*) AS n FROM events WHERE event_id // 3 % 5 < 2 GROUP BY 1""")
def template_cache_cap(t):
    """Each exporter announces five templates in order of their ids; a cache of two keeps the first ones."""
    exporter = _s("e", ID % 3)
    tid = F.floor(ID / 3) % 5 + 256
    wrap = lambda sets, size: F.concat(F.lit("000A"), _h(16 + size, 2), _h(1700000000, 4), _h(0, 4), _h(1, 4), sets)
    data = t("events").select(ID + 100, exporter, F.unhex(wrap(F.concat(_h(tid, 2), _h(8, 2), _SRC), 8)))
    told = t("events").select((ID % 3).alias("e"), tid.alias("i")).distinct()
    told = told.select(F.col("i") - 256, _s("e", F.col("e")), F.unhex(wrap(F.concat(F.lit("0002000C"), _h(F.col("i"), 2), F.lit("000100080004")), 12)))
    sets = flows.split_sets(data.union(told).toDF("seq", "exporter", "payload"))
    return flows.with_templates(sets, most=2).where(F.col("fields").isNotNull()).groupBy("exporter").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 10 END::BIGINT AS protocol_version, {_IP_SQL} AS src_addr, user_id AS packets FROM events""")
def flows_of_any_version(t):
    five = F.concat(F.lit("00050001"), _h(0, 4), _h(1700000000, 4), _h(0, 12), _SRC, _DST, _h(0, 4), _h(1, 2), _h(2, 2), _h(USER, 4), _h(ID, 4), _h(7, 4), _h(9, 4), _h(1, 2), _h(2, 2), F.lit("00"), _h(24, 1), _h(6, 1), F.lit("00"), _h(0, 8))
    sets = F.concat(F.lit("0024"), _h(256, 2), _h(7, 2), F.lit(_FIELDS), _h(256, 2), _h(33, 2), _RECORD)
    nine = F.concat(F.lit("00090002"), _h(0, 4), _h(1700000000, 4), _h(0, 4), _h(5, 4), F.lit("0000"), sets)
    ten = F.concat(F.lit("000A"), _h(16 + 36 + 33, 2), _h(1700000000, 4), _h(0, 4), _h(1, 4), F.lit("0002"), sets)
    body = F.when(ID % 3 == 0, five).when(ID % 3 == 1, nine).otherwise(ten)
    out = flows.decode_datagrams(t("events").select(ID.alias("seq"), F.lit(None).cast("string").alias("exporter"), F.unhex(body).alias("payload")))
    return _big(out.select("protocol_version", "src_addr", F.col("packet_delta_count").alias("packets")), "protocol_version", "packets")


@query(f"""SELECT event_id AS seq, {_IP_SQL} AS src_addr, {_DST_SQL} AS dst_addr, event_id % 65536 AS src_port, 443::BIGINT AS dst_port, 6::BIGINT AS ip_protocol FROM events""")
def sflow_raw_header(t):
    """Sampled Ethernet frames with an IPv4 and a TCP header."""
    frame = F.concat(F.lit("FFFFFFFFFFFF0011223344550800"), F.lit("4500002800000000400600 00".replace(" ", "")), _SRC, _DST, _h(ID % 65536, 2), _h(443, 2), _h(0, 16))
    item = F.concat(_h(1, 4), _h(70, 4), _h(0, 4), _h(54, 4), frame, _h(0, 2))
    sample = F.concat(_h(1, 4), _h(32 + 8 + 72, 4), _h(1, 4), _h(0, 4), _h(512, 4), _h(0, 4), _h(0, 4), _h(1, 4), _h(2, 4), _h(1, 4), _h(1, 4), _h(72, 4), item)
    out = sflow.flow_table(sflow.decode_sflow(t("events").select(ID.alias("seq"), F.unhex(_sflow(sample)).alias("payload"))))
    return _big(out.select("seq", "src_addr", "dst_addr", "src_port", "dst_port", "ip_protocol"), "src_port", "dst_port", "ip_protocol")


@query("""SELECT event_id AS seq, 7::BIGINT AS enterprise, 33::BIGINT AS format, 4::BIGINT AS length, lower(printf('%08x', (event_id % 1000)::BIGINT)) AS data FROM events""")
def sflow_unknown_records(t):
    sample = F.concat(_h(2, 4), _h(24, 4), _h(1, 4), _h(0, 4), _h(1, 4), _h(7 * 4096 + 33, 4), _h(4, 4), _h(ID % 1000, 4))
    out = sflow.counter_table(sflow.decode_sflow(t("events").select(ID.alias("seq"), F.unhex(_sflow(sample)).alias("payload"))))
    item = lambda k: F.get_json_object("extra", f"$[0].{k}")
    return out.select("seq", *[item(k).cast("bigint").alias(k) for k in ("enterprise", "format", "length")], item("data_hex").alias("data"))


_ZEEK = {
    "dns": ('"trans_id":', "trans_id", ',"query":"', "query", '","answers":["a","b"]'),
    "http": ('"status_code":', "status_code", ',"host":"', "host", '","method":"GET"'),
    "ssl": ('"id.orig_p":', "id_orig_p", ',"server_name":"', "server_name", '","version":"v3"'),
    "files": ('"total_bytes":', "total_bytes", ',"filename":"', "filename", '","tx_hosts":["h"]'),
    "notice": ('"id.resp_p":', "id_resp_p", ',"msg":"', "msg", '","actions":"none"'),
}


def _zeek_typed(name: str):
    """A query of one typed stream: a number, a text, and a key that has no column."""
    head, number, middle, text, end = _ZEEK[name]

    def run(t):
        line = _s('{"_path":"', name, '",', head, ID % 60000, middle, KIND, end, ',"more":{"u":', USER, "}}")
        out = json_streams.zeek_table(json_streams.parse_lines(t("events").select(line.alias("value")), "_path"), name)
        return out.select(F.col(number).cast("bigint").alias("number"), F.col(text).alias("text"), F.get_json_object("_extra", "$.more.u").cast("bigint").alias("more"))

    run.__name__ = f"zeek_{name}_typed"
    query("SELECT event_id % 60000 AS number, event_type AS text, user_id AS more FROM events")(run)


for _name in _ZEEK:
    _zeek_typed(_name)


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'conn' WHEN 1 THEN 'Conn' ELSE 'odd path' END AS log_path, CASE WHEN event_id % 3 = 0 THEN 'typed' ELSE 'envelope' END AS form, count(*) AS n FROM events GROUP BY 1, 2""")
def zeek_path_fallback(t):
    """Only the exact path is typed; one that cleaning would turn into the table's name keeps the envelope."""
    line = _s('{"_path":"', F.when(ID % 3 == 0, "conn").when(ID % 3 == 1, "Conn").otherwise("odd path"), '","uid":"C', ID, '"}')
    parsed = json_streams.parse_lines(t("events").select(line.alias("value")), "_path")
    typed = json_streams.zeek_table(parsed, "conn").select(F.get_json_object("_extra", "$._path").alias("log_path"), F.lit("typed").alias("form"))
    rest = json_streams.zeek_envelope(parsed).select("log_path", F.lit("envelope").alias("form"))
    return typed.unionByName(rest).groupBy("log_path", "form").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'oversize' ELSE 'malformed' END AS reason, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1""")
def json_lines_rejected(t):
    line = F.when(ID % 3 == 0, _s('{"a":"', F.repeat(F.lit("x"), 90), '"}')).when(ID % 3 == 1, _s('{"a":', ID)).otherwise(_s('{"a":', ID, "}"))
    return json_streams.rejected_lines(t("events").select(line.alias("value")), max_bytes=80).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS body_id, 'web' AS sourcetype, 'line "' || event_type || '" ' || event_id AS raw FROM events""")
def hec_raw_parse(t):
    rows = t("events").select(ID.alias("body_id"), F.encode(_s('line "', KIND, '" ', ID), "UTF-8").alias("body"), F.lit("web").alias("default_sourcetype"))
    return ingest.hec_raw(rows).select("body_id", "sourcetype", F.get_json_object("fields", "$.raw").alias("raw"))


@query("""SELECT event_id AS body_id, event_id AS i, (event_id + 0.5)::DOUBLE AS d, event_type AS inner_kind, user_id AS second, '0102' AS raw, event_id % 2 = 0 AS flag FROM events""")
def otlp_any_values(t):
    kv = lambda k, v: _s('{"key":"', k, '","value":{', v, "}}")
    pairs = [
        kv("i", _s('"intValue":"', ID, '"')), kv("d", _s('"doubleValue":', ID, ".5")), kv("f", _s('"boolValue":', F.when(ID % 2 == 0, "true").otherwise("false"))), kv("b", F.lit('"bytesValue":"AQI="')),
        kv("l", _s('"arrayValue":{"values":[{"stringValue":"x"},{"intValue":"', USER, '"}]}')), kv("m", _s('"kvlistValue":{"values":[', kv("kind", _s('"stringValue":"', KIND, '"')), "]}")),
    ]
    body = _s('{"resource_logs":[{"scope_logs":[{"log_records":[{"attributes":[', F.concat_ws(",", *pairs), "]}]}]}]}")
    rows = t("events").select(ID.alias("body_id"), F.encode(body, "UTF-8").alias("body"), F.lit("application/json; charset=utf-8").alias("content_type"), F.lit("p").alias("source_host"))
    f = lambda k: F.get_json_object("fields", f"$.{k}")
    return ingest.otlp_logs(rows).select("body_id", f("i").cast("bigint").alias("i"), f("d").cast("double").alias("d"), f("m.kind").alias("inner_kind"), f("l[1]").cast("bigint").alias("second"), f("b").alias("raw"), (f("f") == "true").alias("flag"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 415 ELSE 400 END::BIGINT AS status, count(*) AS n FROM events WHERE event_id % 4 < 2 GROUP BY 1""")
def otlp_rejected_bodies(t):
    kind = F.when(ID % 4 == 0, "text/plain").when(ID % 4 == 3, "application/x-protobuf").otherwise("application/json")
    rows = t("events").select(ID.alias("body_id"), F.encode(F.when(ID % 4 == 1, "{").when(ID % 4 == 2, "{}").otherwise(""), "UTF-8").alias("body"), kind.alias("content_type"))
    return ingest.otlp_rejected(rows).groupBy(F.col("status").cast("bigint").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 16 < 8) AS allowed, count(*) AS n FROM events GROUP BY 1""")
def ipv6_allowlist(t):
    ip = F.when(ID % 3 == 0, _s("2001:DB8::", F.lower(F.hex(ID % 4096)))).when(ID % 3 == 1, _s("fd00:1:2:3:4:5:6:", F.lower(F.hex(ID % 16)))).otherwise(_s("2001:db9::", ID % 10, "::1"))
    return t("events").groupBy(route.allowed(ip, ["2001:db8::/32", "fd00:1:2:3:4:5:6:0/125", "10.0.0.0/8"]).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id % 2 = 0 AS short, count(*) AS n FROM events WHERE event_id % 5 > 0 GROUP BY 1""")
def oversize_datagrams(t):
    data = F.when(ID % 5 == 0, F.repeat(F.lit("y"), 70)).when(ID % 2 == 0, F.lit("ab")).otherwise(F.lit("abcdef"))
    rows = t("events").select(ID.alias("seq"), TS.cast("timestamp").alias("received_at"), F.lit("e").alias("exporter"), F.encode(data, "UTF-8").alias("payload"))
    return network.lines_of(rows, 64).groupBy((F.length("value") == 2).alias("short")).agg(F.count(F.lit(1)).alias("n"))


def _columns() -> None:
    """The columns that the queries render records from; made when a query runs, as they need a session."""
    global ID, USER, KIND, TS, _IP, _STAMP, _ISO, _CEF, _LEEF, _AUDIT, _DHCP, _RADIUS, _WEB, _HEC, _SRC, _DST, _RECORD
    ID, USER, KIND, TS = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("ts")
    _IP = _s("10.", USER % 5, ".", F.floor(ID / 256) % 256, ".", ID % 256)
    _STAMP = F.date_format(TS, "MMM d HH:mm:ss")
    _ISO = F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    _CEF = _s("CEF:0|Acme|FW|1.0|SIG", ID % 7, "|Rule \\| ", KIND, "|", ID % 10, "|src=", _IP, " spt=", ID % 65536, " msg=user ", USER, " did ", KIND, " act=ok")
    _LEEF = F.when(ID % 2 == 0, _s("LEEF:1.0|Acme|IDS|2.1|", KIND, "|src=", _IP, "\tusrName=u", USER)).otherwise(_s("LEEF:2.0|Acme|IDS|2.1|", KIND, "|^|src=", _IP, "^usrName=u", USER))
    _AUDIT = _s("type=SYSCALL msg=audit(1700000000.", ID % 1000, ":", ID, '): arch=c000003e syscall=', ID % 300, ' comm="', KIND, '" uid=', USER)
    _DHCP = F.when(ID % 3 == 0, _s("DHCPACK on ", _IP, f" to {_MAC} (h", USER, ") via eth0")).when(ID % 3 == 1, _s("DHCPREQUEST for ", _IP, f" from {_MAC} via eth1")).otherwise(F.lit(f"DHCPDISCOVER from {_MAC}"))
    _RADIUS = F.when(ID % 2 == 0, _s("Login OK: [u", USER, "] (from client vpn port ", ID % 100, " cli ", _IP, ")")).otherwise(_s("Login incorrect (PAP): [u", USER, "] (from client vpn port ", ID % 100, ")"))
    _WEB = _s(_IP, " - ", F.when(USER % 2 == 0, _s("u", USER)).otherwise("-"), ' [15/Jan/2024:10:31:00 +0000] "GET /', KIND, ' HTTP/1.1" ', F.when(ID % 10 == 0, 404).otherwise(200), " ", ID, ' "-" "curl/8"')
    _HEC = _s('{"event":{"id":', ID, ',"kind":"', KIND, '"},', F.when(ID % 3 == 0, "").otherwise(_s('"sourcetype":"', KIND, '",')), '"host":"h', USER, '","time":', F.lit(1700000000) + ID, ".5}")
    _SRC = F.concat(F.lit("0A"), _h(USER % 5, 1), _h(F.floor(ID / 256) % 256, 1), _h(ID % 256, 1))
    _DST = F.concat(F.lit("C00002"), _h(ID % 256, 1))
    _RECORD = F.concat(_SRC, _DST, _h(ID % 65536, 2), _h(80, 2), _h(17, 1), _h(ID * 10, 8), _h(USER, 8))

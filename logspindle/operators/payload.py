"""Structured payloads inside syslog messages: CEF, LEEF, auditd, DHCP, RADIUS, web access, DNS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bind, blank_null, hyphen_null, last_wins, regex_groups
from .syslog import parse_dns

_PART = r"((?:\\.|[^|\\])*)"
CEF = r"(?s)^CEF:" + r"\|".join([_PART] * 7) + r"(?:\|(.*))?\z"
# Patterns of the line formats.
AUDITD = r"(?ds)^type=(\S+)\s+msg=audit\(([^)]+)\):\s*(.*)\z"
_HOST = r"(?:\s+\(([^)]+)\))?(?:\s+via\s+(\S+))?"
DHCP_ON = r"(?s)^(DHCPACK|DHCPOFFER|DHCPNAK)\s+on\s+(\S+)\s+to\s+([\da-fA-F:]+)" + _HOST + r".*\z"
DHCP_FROM = r"(?s)^(DHCPREQUEST|DHCPRELEASE)\s+(?:for|of)\s+(\S+)\s+from\s+([\da-fA-F:]+)" + _HOST + r".*\z"
DHCP_DISCOVER = r"(?s)^(DHCPDISCOVER)()\s+from\s+([\da-fA-F:]+)" + _HOST + r".*\z"
_CLIENT = r"\[([^\]]+)\]\s+\(from client\s+(\S+)\s+port\s+(\S+)(?:\s+cli\s+(\S+))?\).*\z"
RADIUS_OK = r"(?s)^Login OK():\s+" + _CLIENT
RADIUS_FAIL = r"(?s)^Login incorrect(?:\s+\(([^)]+)\))?:\s+" + _CLIENT
WEB = r'(?s)^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)".*\z'


def _entries(keys: Column, values: Column) -> Column:
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def cef_extensions(text: Column) -> Column:
    """key=value pairs; a value goes on to the next ``key=`` token."""
    marked = F.regexp_replace(F.trim(text), r"([A-Za-z0-9_]+)=|([^ ]+)", "\u0001$1\u0002$2")
    parts = F.filter(F.split(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001"), lambda p: p.contains("\u0002"))
    whole = lambda p: F.rtrim(F.substr(p, F.instr(p, "\u0002") + 1))
    value = lambda p: F.when(p.contains("\\"), F.regexp_replace(whole(p), r"\\([|\\=])", "$1")).otherwise(whole(p))
    return last_wins(F.transform(parts, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("key"), value(p).alias("value"))))


def cef(message: Column) -> Column:
    names = ["device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]

    def made(g: Column) -> Column:
        plain = lambda c: F.when(c.contains("\\"), F.regexp_replace(c, r"\\([|\\])", "$1")).otherwise(c)
        version = F.regexp_extract(g[0], r"^\+?0*(\d{1,3})\z", 1).try_cast("int")
        return F.when(version.between(0, 255), F.struct(version.alias("version"), *[plain(g[i + 1]).alias(n) for i, n in enumerate(names)], cef_extensions(g[7]).alias("extensions")))

    return F.when(message.startswith("CEF:"), bind(regex_groups(message, CEF, 8), made))


def _delimiter(spec: Column) -> Column:
    s = F.trim(F.regexp_replace(spec, r"^\s+|\s+\z", ""))
    code = F.regexp_extract(s, r"^0[xX]([0-9a-fA-F]{1,2})\z", 1)
    return F.when((s == "") | (s == "\\t"), F.lit("\t")).when(code != "", F.char(F.conv(code, 16, 10).cast("long"))).otherwise(F.left(s, F.lit(1)))


def leef_attributes(text: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    key = lambda p: F.regexp_replace(F.substring_index(p, "=", 1), r"^\s+|\s+\z", "")
    pairs = F.filter(F.split(text, quoted), lambda p: p.contains("=") & (key(p) != ""))
    return last_wins(F.transform(pairs, lambda p: F.struct(key(p).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value"))))


def leef(message: Column) -> Column:
    return F.when(message.startswith("LEEF:"), bind(F.split(F.substr(message, F.lit(6)), r"\|", 7), _leef))


def _leef(p: Column) -> Column:
    at = lambda i: F.try_element_at(p, F.lit(i + 1))
    six, seven = F.coalesce(at(5), F.lit("")), at(6)
    two = at(0) == "2.0"
    hexed = six.rlike("^0[xX]")
    first = F.left(six, F.lit(1))
    delimiter = F.when(two, F.when(seven.isNotNull(), _delimiter(six)).when(six == "", F.lit("\t")).when(hexed, _delimiter(six)).otherwise(first))
    blob = F.when(two, F.when(seven.isNotNull(), seven).when((six == "") | hexed, F.lit("")).otherwise(F.substr(six, F.lit(2)))).otherwise(six)
    names = ["leef_version", "vendor", "product", "version", "event_id"]
    made = F.struct(*[at(i).alias(n) for i, n in enumerate(names)], delimiter.alias("delimiter"), leef_attributes(blob, F.coalesce(delimiter, F.lit("\t"))).alias("attributes"))
    return F.when(F.size(p) >= 5, made)


def auditd(message: Column) -> Column:
    """The pairs end at the first token without ``=``."""
    pair = r'([^= ]*)=("[^"]*"?|(?!")[^ ]*)'

    def fields(good: Column) -> Column:
        keys, values = (F.regexp_extract_all(good, F.lit(pair), F.lit(i)) for i in (1, 2))
        bare = F.transform(values, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substr(v, F.lit(2)), '"\\z', "")).otherwise(v))
        return last_wins(_entries(keys, bare))

    made = lambda g: F.when(g.isNotNull(), F.struct(g[0].alias("record_type"), g[1].alias("audit_id"), bind(F.regexp_extract(g[2], rf"^(?: *{pair})*+", 0), fields).alias("fields")))
    return F.when(message.startswith("type="), bind(regex_groups(message, AUDITD, 3), made))


def dhcp(message: Column) -> Column:
    g = F.coalesce(*[regex_groups(message, p, 5) for p in (DHCP_ON, DHCP_FROM, DHCP_DISCOVER)])
    names = ["message_type", "ip", "mac", "hostname", "interface"]
    made = lambda g: F.when(g.isNotNull(), F.struct(*[blank_null(g[i]).alias(n) for i, n in enumerate(names)]))
    return F.when(message.startswith("DHCP"), bind(g, made))


def radius(message: Column) -> Column:
    names = ["method", "username", "client", "port", "client_ip"]

    def made(outcome: str):
        return lambda g: F.when(g.isNotNull(), F.struct(F.lit(outcome).alias("outcome"), *[blank_null(g[i]).alias(n) for i, n in enumerate(names)]))

    ok, bad = bind(regex_groups(message, RADIUS_OK, 5), made("ok")), bind(regex_groups(message, RADIUS_FAIL, 5), made("fail"))
    return F.when(message.startswith("Login OK"), ok).when(message.startswith("Login incorrect"), bad)


def web_access(message: Column) -> Column:
    return bind(regex_groups(message, WEB, 11), _web)


def _web(g: Column) -> Column:
    number = lambda c: F.when(c.rlike(r"^\d{1,18}\z"), c.cast("long"))
    made = F.struct(
        g[0].alias("client_ip"), g[1].alias("ident"), hyphen_null(g[2]).alias("authuser"), g[3].alias("timestamp"), g[4].alias("method"), g[5].alias("path"), g[6].alias("protocol"),
        g[7].cast("int").alias("status"), number(g[8]).alias("bytes"), hyphen_null(g[9]).alias("referer"), hyphen_null(g[10]).alias("user_agent"),
    )
    return F.when(g.isNotNull(), made)


#: In the order they are tried; DNS comes last.
PARSERS = {"cef": cef, "leef": leef, "auditd": auditd, "dhcp": dhcp, "radius": radius, "web_access": web_access}


def dispatch(messages: DataFrame, col: str = "message", *, keep_parts: bool = False) -> DataFrame:
    """``messages`` with payload_type and parsed (JSON text) of the first format that fits; both null if none does.

    With ``keep_parts`` a struct column of each format is kept too (``cef``, ``leef`` ...), null but for the one that fits.
    """
    out, before = messages, F.lit(False)
    for name, parse in PARSERS.items():
        out = out.withColumn(f"__{name}", F.when(~before, parse(F.col(col))))
        before = before | F.col(f"__{name}").isNotNull()
    out = parse_dns(out, col)
    parts = {**{n: F.col(f"__{n}") for n in PARSERS}, "dns": F.when(~before, F.col("dns"))}
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, c in reversed(list(parts.items())):
        kind, text = F.when(c.isNotNull(), name).otherwise(kind), F.when(c.isNotNull(), F.to_json(c)).otherwise(text)
    named = [c for c in messages.columns if c not in ("payload_type", "parsed")]
    kept = [c.alias(n) for n, c in parts.items()] if keep_parts else []
    # generated columns keep later filters from being pushed down, which would copy every parser into their conditions
    held = F.struct(kind.alias("payload_type"), text.alias("parsed"), *kept)
    out = out.select(*named, F.explode_outer(F.array(held)).alias("__held"))
    return out.select(*named, *[F.col(f"__held.{c}") for c in ("payload_type", "parsed", *(parts if keep_parts else ()))])


def structured_records(parsed: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Rows of the structured table: envelope and payload of those syslog rows that have one."""
    out = dispatch(parsed).where(F.col("payload_type").isNotNull())
    at = received_at if received_at is not None else F.current_timestamp()
    return out.select("priority", "severity", "facility", "timestamp", "hostname", "app_name", at.alias("received_at"), "payload_type", "parsed")

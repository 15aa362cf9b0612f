"""Syslog lines to columns: RFC 5424, then RFC 3164."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bind, blank_null, hyphen_null, last_wins, regex_groups, rfc3339

# Header patterns.
RFC5424 = r"(?d)^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*?)\z"
RFC3164 = r"(?d)^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*?)\z"
TAG = r"(?d)^([^:\[]+)(?:\[(\d+)\])?:\s*(.*)\z"
STAMP = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

COLUMNS = ["priority", "severity", "facility", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message", "structured_data", "protocol"]


def structured_data(rest: Column) -> Column:
    """map<id, map<name, value>> of all bracketed elements; null if there are none."""
    elements = F.filter(F.regexp_extract_all(rest, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda e: F.trim(e) != "")
    param = F.lit(r'(\S+)="([^"]*)"')
    pairs = lambda e: F.zip_with(
        F.regexp_extract_all(e, param, F.lit(1)), F.regexp_extract_all(e, param, F.lit(2)), lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    )
    named = lambda all_: F.transform(all_, lambda e: F.struct(F.regexp_extract(e, r"^\s*(\S+)", 1).alias("key"), last_wins(pairs(e)).alias("value")))
    return F.when(rest.startswith("["), bind(elements, lambda e: F.when(F.size(e) > 0, last_wins(named(e)))))


def timestamp_3164(text: Column, year: Column) -> Column:
    """A time of ``year``; null where the date doesn't exist."""
    n = lambda c: c.cast("int")

    def made(p: Column) -> Column:
        month = F.instr(F.lit(MONTHS), F.lower(p[0]))
        return F.when((month % 3 == 1), F.try_make_timestamp(year.cast("int"), ((month + 2) / 3).cast("int"), n(p[1]), n(p[2]), n(p[3]), n(p[4]).cast("decimal(16,6)"), F.lit("UTC")))

    return bind(regex_groups(text, STAMP, 5), made)


def parse_syslog(lines: DataFrame, col: str = "value", *, year: Column | int | None = None, strict_rfc: bool = False) -> DataFrame:
    """``lines`` with the columns of ``COLUMNS``; all null where neither format fits.

    ``year`` is that of RFC 3164 times (default: the current one). By default brackets anywhere after an
    element count as structured data and a lone ``-`` in its place stays in the message, as in the systems whose tables this
    reproduces; ``strict_rfc`` reads RFC 5424 to the letter instead. Works on static and streaming frames.
    """
    year = F.year(F.current_timestamp()) if year is None else F.lit(year) if isinstance(year, int) else year
    line = F.col(col)
    staged = lines.withColumn("__n", regex_groups(line, RFC5424, 8)).withColumn("__n", F.when(F.col("__n")[0].cast("int") <= 255, F.col("__n")))
    staged = staged.withColumn("__o", F.when(F.col("__n").isNull(), regex_groups(line, RFC3164, 4))).withColumn("__o", F.when(F.col("__o")[0].cast("int") <= 255, F.col("__o")))
    n, o, rest = F.col("__n"), F.col("__o"), F.col("__n")[7]
    staged = staged.withColumn("__t", regex_groups(o[3], TAG, 3))
    t = F.col("__t")
    if strict_rfc:
        element = r'\[[^\s\]=]+(?:\s+[^\s=\]]+="(?:\\.|[^"\\])*")*\s*\]'
        head = F.regexp_extract(rest, rf"^(?:{element})+", 0)
        sd = structured_data(head)
        after = F.when(rest.rlike(r"^-(\s|\z)"), F.regexp_replace(rest, r"^-\s*", "")).otherwise(F.substr(rest, F.length(head) + 1))
        message = F.ltrim(after)
    else:
        staged = staged.withColumn("__sd", structured_data(rest))
        sd = F.col("__sd")
        message = F.when(sd.isNotNull(), F.ltrim(F.regexp_replace(rest, r"(?s)^.*\[[^\]]*[^\]\s][^\]]*\](.*?)\z", "$1"))).otherwise(rest)
    message = F.regexp_replace(message, "^\ufeff", "")
    staged = staged.withColumn("priority", F.coalesce(n[0], o[0]).cast("int"))
    out = {
        "severity": F.col("priority").bitwiseAND(7),
        "facility": F.shiftright("priority", 3).bitwiseAND(31),
        "timestamp": F.coalesce(rfc3339(n[2]), timestamp_3164(o[1], year)),
        "hostname": F.coalesce(hyphen_null(n[3]), o[2]),
        "app_name": F.coalesce(hyphen_null(n[4]), t[0]),
        "proc_id": F.coalesce(hyphen_null(n[5]), blank_null(t[1])),
        "msg_id": hyphen_null(n[6]),
        "message": F.when(n.isNotNull(), message).otherwise(F.coalesce(t[2], o[3])),
        "structured_data": sd,
        "protocol": F.when(n.isNotNull(), "Rfc5424").when(o.isNotNull(), "Rfc3164"),
    }
    for name, c in out.items():
        staged = staged.withColumn(name, c)
    keep = [c for c in lines.columns if c not in COLUMNS]
    return staged.select(*keep, *COLUMNS)


# Name-server query lines; address, name, class, type, answer by group.
_IP = r"\d+\.\d+\.\d+\.\d+"
BIND = rf"(?d)client\s+({_IP})#\d+:\s+query:\s+(\S+)\s+(\S+)\s+(\S+)\s+.*\(({_IP})\)"
UNBOUND = rf"info:\s+({_IP})\s+(\S+)\s+(\S+)\s+(\S+)"
POWERDNS = rf"Remote\s+({_IP})\s+wants\s+'([^|]+)\|([^']+)'"


def parse_dns(messages: DataFrame, col: str = "message") -> DataFrame:
    """``messages`` with dns: a struct of client_ip, query_name, query_type, response_code, response_ips, duration_ms, server; null if it is no query line.

    BIND is tried first, then Unbound, then PowerDNS. The pattern may stand anywhere in the message.
    """
    whole = lambda p: r"(?s)^.*?(?:" + p + r").*\z"
    text = F.col(col)
    b, u, p = (F.when(text.contains(sign), regex_groups(text, whole(x), n)) for x, n, sign in ((BIND, 5, "query:"), (UNBOUND, 4, "info:"), (POWERDNS, 3, "wants")))
    staged = messages.withColumn("__b", b).withColumn("__u", F.when(F.col("__b").isNull(), u)).withColumn("__p", F.when(F.col("__b").isNull() & F.col("__u").isNull(), p))
    made = lambda g, name, kind, ips, server: F.struct(g[0].alias("client_ip"), name.alias("query_name"), kind.alias("query_type"), F.lit("NOERROR").alias("response_code"), ips.alias("response_ips"), F.lit(None).cast("double").alias("duration_ms"), F.lit(server).alias("server"))
    none = F.array().cast("array<string>")
    b, u, p = F.col("__b"), F.col("__u"), F.col("__p")
    dns = F.when(b.isNotNull(), made(b, b[1], b[3], F.array(b[4]), "bind")).when(u.isNotNull(), made(u, F.regexp_replace(u[1], r"\.+\z", ""), u[2], none, "unbound")).when(p.isNotNull(), made(p, p[1], p[2], none, "powerdns"))
    return staged.withColumn("dns", dns).drop("__b", "__u", "__p")

"""Routing: partition caps, buffer caps, date layout, address lists, record formatting."""

from __future__ import annotations

import ipaddress
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bind, ipv4_number, ipv6_hex, xml_escape

OVERFLOW = "_overflow"
#: Keys that are broadcast at most; with a larger cap they are joined by shuffle.
BROADCAST_KEYS = 1 << 16


def cap_partitions(rows: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """Adds segment: ``key`` for the ``most`` keys seen first by ``seq``, else ``_overflow`` (``most`` 0: no cap).

    Keys are ranked on their first occurrences, so one row a key is ordered, not one a record.
    """
    if not most:
        return rows.withColumn("segment", F.col(key))
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(seq).alias("__first"))
    kept = first.orderBy("__first", "__key").limit(most)
    joined = rows.join(F.broadcast(kept) if most <= BROADCAST_KEYS else kept.hint("merge"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("segment", F.when(F.col("__first").isNotNull(), F.col(key)).otherwise(OVERFLOW)).drop("__key", "__first")


def drop_oldest(rows: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key (0: all)."""
    if not most:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("__n") <= most).drop("__n")


def with_date(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds year, month and day (text, zero-padded) of ``at``, by default the time of writing."""
    at = at if at is not None else F.current_timestamp()
    return rows.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")})


def allowed(ip: Column, networks: list[str]) -> Column:
    """Whether the address lies in one of ``networks`` (none: all do). Bad entries raise an error. IPv6 is compared as 32 digits."""
    if not networks:
        return F.lit(True)
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    out = F.lit(False)
    for version, value, form in ((4, ipv4_number(ip), int), (6, ipv6_hex(ip), lambda a: f"{int(a):032x}")):
        mine = [n for n in nets if n.version == version]
        if mine:
            out = out | bind(value, partial(_any, [(form(n.network_address), form(n.broadcast_address)) for n in mine]))
    return out


def _any(ranges: list, value: Column) -> Column:
    return F.coalesce(reduce(or_, (value.between(*r) for r in ranges)), F.lit(False))


def rfc5424_line(level: Column, received_at: Column, source_host: Column, event_id: Column, raw_xml: Column) -> Column:
    """An event as a syslog line; facility 16, severity by level (6 for unparsed events)."""
    severity = F.when(level == "Critical", 2).when(level == "Error", 3).when(level == "Warning", 4).when(level == "Verbose", 7).otherwise(6)
    flat = F.replace(F.replace(raw_xml, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.concat(F.lit("<"), (severity + 128).cast("string"), F.lit(">1 "), received_at, F.lit(" "), source_host, F.lit(" WEF - - ["), event_id, F.lit("] "), flat)


_SOAP = '<s:Envelope xmlns:s="http://www.w3.org/2003/05/soap-envelope"><s:Body>{}</s:Body></s:Envelope>'


def subscription_response(subscription_id: Column) -> Column:
    before, after = _SOAP.format("<SubscriptionId>|</SubscriptionId>").split("|")
    return F.concat(F.lit(before), xml_escape(subscription_id), F.lit(after))


def heartbeat_response() -> Column:
    return F.lit(_SOAP.format("<Heartbeat/>"))

"""IPFIX and NetFlow v9: datagrams to sets, templates joined as of each set, data sets to flow rows.

Splitting datagrams into sets needs no state, so it runs anywhere; what depends on order is which template a data set
meets. That is an as-of join on (exporter, domain, template id) over the datagrams' sequence, span by span of it.
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import be_uint
from ..ship import map_arrow
from .netflow5 import decode_netflow_v5

# Information elements, name and type by id.
ELEMENTS = {
    1: ("octetDeltaCount", "u64"), 2: ("packetDeltaCount", "u64"), 4: ("protocolIdentifier", "u8"), 6: ("tcpControlBits", "u8"), 7: ("sourceTransportPort", "u16"),
    8: ("sourceIPv4Address", "ip4"), 10: ("ingressInterface", "u32"), 11: ("destinationTransportPort", "u16"), 12: ("destinationIPv4Address", "ip4"), 14: ("egressInterface", "u32"),
    21: ("flowEndSysUpTime", "uptime"), 22: ("flowStartSysUpTime", "uptime"), 27: ("sourceIPv6Address", "ip6"), 28: ("destinationIPv6Address", "ip6"), 32: ("icmpTypeCodeIPv4", "u16"),
    56: ("sourceMacAddress", "u64"), 58: ("vlanId", "u16"), 60: ("ipVersion", "u8"), 61: ("flowDirection", "u8"), 62: ("ipNextHopIPv6Address", "ip6"), 64: ("bgpNextHopIPv6Address", "ip6"),
    70: ("mplsTopLabelType", "u8"), 89: ("forwardingStatus", "u8"), 96: ("mpls_vpn_rd", "u64"), 130: ("exporterIPv4Address", "ip4"), 131: ("exporterIPv6Address", "ip6"),
    136: ("flowEndReason", "u8"), 148: ("flowId", "u64"), 152: ("flowStartMilliseconds", "millis"), 153: ("flowEndMilliseconds", "millis"), 176: ("icmpTypeIPv4", "u8"), 177: ("icmpCodeIPv4", "u8"),
    225: ("postNATSourceIPv4Address", "ip4"), 226: ("postNATDestinationIPv4Address", "ip4"), 227: ("postNAPTSourceTransportPort", "u16"), 228: ("postNAPTDestinationTransportPort", "u16"),
}
# Elements with a column of their own.
COLUMN_OF = {1: "octet_delta_count", 2: "packet_delta_count", 4: "ip_protocol", 6: "tcp_flags", 7: "src_port", 227: "src_port", 11: "dst_port", 228: "dst_port", 8: "src_addr", 225: "src_addr", 12: "dst_addr", 226: "dst_addr", 10: "input_interface", 14: "output_interface", 152: "flow_start", 153: "flow_end"}
_SIZE = {"u8": 1, "u16": 2, "u32": 4, "u64": 8}
MAX_TEMPLATES = 100_000


class Malformed(ValueError):
    """A datagram whose structure is wrong."""


def _fields(body: bytes, at: int, count: int, enterprise: bool, lenient: bool = False) -> tuple[list[tuple[int, int, int]], int]:
    out = []
    for _ in range(count):
        if at + 4 > len(body):
            if lenient:
                break
            raise Malformed("template cut short")
        ie, size = struct.unpack_from(">HH", body, at)
        at, pen = at + 4, -1
        if enterprise and ie & 0x8000:
            if at + 4 > len(body):
                if lenient:
                    break
                raise Malformed("template cut short")
            pen = struct.unpack_from(">I", body, at)[0]
            at += 4
        out.append((ie & 0x7FFF if enterprise else ie, size, pen))
    return out, at


def _templates(body: bytes, version: int) -> Iterator[tuple[int, list]]:
    at = 0
    while at + 4 <= len(body):
        tid, count = struct.unpack_from(">HH", body, at)
        if tid < 256:
            if version == 9:
                return
            raise Malformed("a template id below 256")
        fields, at = _fields(body, at + 4, count, version == 10)
        yield tid, fields


def _options(body: bytes) -> Iterator[tuple[int, list]]:
    at = 0
    while at + 6 <= len(body):
        tid, count, _ = struct.unpack_from(">HHH", body, at)
        fields, at = _fields(body, at + 6, count, True, lenient=True)
        if tid >= 256:
            yield tid, fields


def sets_of(data: bytes) -> tuple[int, int, int, list[tuple[str, int, object]], str | None]:
    """version, domain, export seconds, the datagram's sets, and what is wrong with it.

    A set is ("template", id, fields) or ("data", id, bytes). Of a malformed datagram only the templates before the fault remain.
    """
    sets: list[tuple[str, int, object]] = []
    version = domain = seconds = 0
    try:
        if len(data) < 2:
            raise Malformed("truncated")
        version = struct.unpack_from(">H", data)[0]
        if version not in (9, 10):
            raise Malformed(f"version {version}")
        at = 16 if version == 10 else 20
        if len(data) < at:
            raise Malformed("truncated")
        seconds = struct.unpack_from(">I", data, 4 if version == 10 else 8)[0]
        domain = struct.unpack_from(">I", data, at - 4)[0]
        end = len(data)
        if version == 10:
            end = struct.unpack_from(">H", data, 2)[0]
            if not at <= end <= len(data):
                raise Malformed("truncated")
        while at + 4 <= end:
            sid, size = struct.unpack_from(">HH", data, at)
            if size < 4 or at + size > end:
                raise Malformed("a set beyond the datagram")
            body = data[at + 4 : at + size]
            if sid == (2 if version == 10 else 0):
                sets += (("template", tid, f) for tid, f in _templates(body, version))
            elif sid == 3 and version == 10:
                sets += (("template", tid, f) for tid, f in _options(body))
            elif sid >= 256:
                sets.append(("data", sid, body))
            at += size
    except Malformed as e:
        return version, domain, seconds, [s for s in sets if s[0] == "template"], str(e)
    return version, domain, seconds, sets, None


def flow(fields: list[tuple[int, int, int]], record: bytes) -> dict:
    """Columns of one data record; what has none goes to ``extra``."""
    out: dict = {}
    extra: dict = {}
    at = 0
    for ie, size, pen in fields:
        raw = record[at : at + size]
        at += size
        name, kind = ELEMENTS.get(ie, (f"ie{ie}", "hex")) if pen < 0 else (f"ie{pen}:{ie}", "hex")
        value: object = raw.hex()
        if kind in _SIZE:
            n = _SIZE[kind]
            value = int.from_bytes(raw[:n], "big")
        elif kind in ("ip4", "ip6") and len(raw) == (4 if kind == "ip4" else 16):
            value = str(ipaddress.ip_address(raw))
        elif kind == "uptime" and len(raw) >= 4:
            value = int.from_bytes(raw[:4], "big")
        elif kind == "millis" and len(raw) >= 8:
            ms = int.from_bytes(raw[:8], "big")
            if ms < 253_402_300_800_000:
                out[COLUMN_OF[ie]] = ms
            continue
        column = COLUMN_OF.get(ie) if kind != "hex" else None
        if column and not (isinstance(value, str) and kind in ("ip4", "ip6") and "." not in value) and kind != "millis":
            out[column] = value
        else:
            extra[name] = value
    return out | {"extra": json.dumps(extra, sort_keys=True)}


_SETS = "exporter string, seq long, part int, version int, domain long, export_time long, kind string, template_id int, fields string, body binary, error string"


def split_sets(datagrams: DataFrame) -> DataFrame:
    """A row for each set of (payload, exporter, seq); a malformed datagram also has one of kind ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in _SETS.split(", ")]
        for batch in batches:
            rows = []
            for payload, exporter, seq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                version, domain, seconds, sets, error = sets_of(payload or b"")
                for part, (kind, tid, what) in enumerate(sets):
                    rows.append((exporter, seq, part, version, domain, seconds, kind, tid, json.dumps(what) if kind == "template" else None, what if kind == "data" else None, None))
                if error:
                    rows.append((exporter, seq, len(sets), version, domain, seconds, "error", None, None, None, error))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return map_arrow(datagrams.select("payload", "exporter", "seq"), run, _SETS)


#: A span of so many numbers of datagrams (a power of two) is sorted together; of each span before, only the last template counts.
SPAN = 1024


def with_templates(sets: DataFrame, *, most: int = MAX_TEMPLATES) -> DataFrame:
    """Data sets with the fields of the latest template before them; fields is null where none was seen.

    Of each exporter the ``most`` templates seen first count; later ones are left out, as a full cache does. A null exporter is an exporter.
    Sets are dealt by template and span of ``seq``, so that a busy exporter's, each with its template, spread over tasks; a span begins
    with the last template before it. Finding that takes a row for each template and span, the fewer the denser ``seq`` is.
    """
    key = ["exporter", "domain", "template_id"]
    span = F.shiftright("seq", SPAN.bit_length() - 1).alias("__span")
    at = (F.shiftleft(F.coalesce(F.col("seq").bitwiseAND(SPAN - 1), F.lit(0).cast("long")), 31) + F.col("part")).alias("__at")  # a long, which a hash aggregate can hold
    told = sets.where(F.col("kind").isin("template", "data")).select("*", span, at)
    spans = told.groupBy(*key, "__span", "fields").agg(F.min("__at").alias("low"), F.max("__at").alias("high"))
    known = F.col("fields").isNotNull()
    # Both structs hold low and high, so that what either is used for needs the same columns and the datagrams are split once for both.
    spans = spans.groupBy(*key, "__span").agg(F.min(F.when(known, F.struct("low", "high"))).alias("low"), F.max(F.when(known, F.struct("high", "fields", "low")))["fields"].alias("last"))
    first = spans.where(F.col("low").isNotNull()).groupBy(*key).agg(F.min(F.struct("__span", "low")).alias("first"))
    place = F.row_number().over(Window.partitionBy("exporter").orderBy("first", *key[1:]))
    full = first.withColumn("place", place).where(F.col("place") > most).select(*[F.col(k).alias(f"x_{k}") for k in key], F.lit("full").alias("full"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.select(*key, "__span", before.alias("fields")).join(full, reduce(and_, (F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in key)), "left")
    begins = begins.select(*key, "__span", F.lit(-1).cast("long").alias("__at"), F.coalesce("full", F.lit("before")).alias("kind"), "fields")
    # One row begins each span; at equal places a data set, which has no fields, comes before a template.
    w = Window.partitionBy(*key, "__span").orderBy("__at", "fields").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = told.unionByName(begins, allowMissingColumns=True)
    latest = F.when(F.first("kind").over(w) != "full", F.last("fields", ignorenulls=True).over(w))
    return all_.withColumn("fields", latest).where(F.col("kind") == "data").select(*[F.col(c) for c in sets.columns if c != "fields"], "fields")


_FLOW = [
    ("seq", pa.int64()), ("part", pa.int32()), ("record_no", pa.int32()), ("observation_domain_id", pa.int64()), ("template_id", pa.int32()), ("protocol_version", pa.int32()), ("exporter", pa.string()), ("export_seconds", pa.int64()),
    ("src_addr", pa.string()), ("dst_addr", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("ip_protocol", pa.int16()), ("octet_delta_count", pa.decimal128(20)), ("packet_delta_count", pa.decimal128(20)),
    ("flow_start", pa.int64()), ("flow_end", pa.int64()), ("tcp_flags", pa.int16()), ("input_interface", pa.int64()), ("output_interface", pa.int64()), ("extra", pa.string()),
]
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short", pa.string(): "string", pa.decimal128(20): "decimal(20,0)"}
_TYPES = dict(_FLOW)
FLOW_SCHEMA = ", ".join(f"{n} {_SQL[t]}" for n, t in _FLOW)


def records(fields: list, body: bytes) -> list[dict]:
    """Flows of a data set: whole records only; none for templates without length or of variable length."""
    size = sum(f[1] for f in fields)
    if not size or any(f[1] == 0xFFFF for f in fields):
        return []
    return [flow(fields, body[i : i + size]) for i in range(0, len(body) - size + 1, size)]


def flow_batch(rows: list[dict]) -> pa.RecordBatch:
    from decimal import Decimal

    big = ("octet_delta_count", "packet_delta_count")
    return pa.RecordBatch.from_arrays([pa.array([Decimal(r[n]) if n in big and r.get(n) is not None else r.get(n) for r in rows], t) for n, t in _FLOW], [n for n, _ in _FLOW])


def finish(raw: DataFrame) -> DataFrame:
    """Times as timestamps, in the order of the stored table."""
    ms = lambda c: F.timestamp_millis(c).alias(c)
    shown = {"export_seconds": F.timestamp_seconds("export_seconds").alias("export_time"), "flow_start": ms("flow_start"), "flow_end": ms("flow_end")}
    return raw.select(*[shown.get(n, F.col(n)) for n, _ in _FLOW])


def decode_flows(datagrams: DataFrame) -> DataFrame:
    """Flow rows of IPFIX and NetFlow v9 datagrams (payload, exporter, seq). Sets without a template before them give none."""
    joined = with_templates(split_sets(datagrams)).where(F.col("fields").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, part, version, domain, seconds, exporter, tid, fields, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for i, r in enumerate(records(json.loads(fields), body)):
                    out.append(r | {"seq": seq, "part": part, "record_no": i, "observation_domain_id": domain, "template_id": tid, "protocol_version": version, "exporter": exporter, "export_seconds": seconds})
            yield flow_batch(out)

    source = joined.select("seq", "part", "version", "domain", "export_time", "exporter", "template_id", "fields", "body")
    return finish(map_arrow(source, run, FLOW_SCHEMA))


def decode_datagrams(datagrams: DataFrame) -> DataFrame:
    """Flow rows of datagrams (payload, exporter, seq) of any version: NetFlow v5, v9 and IPFIX by their first two bytes; others give none."""
    version = be_uint(F.col("payload"), 0, 2)
    fixed = decode_netflow_v5(datagrams.where(version == 5)).withColumn("part", F.lit(0))
    return decode_flows(datagrams.where(version.isin(9, 10))).unionByName(fixed)


def missing_templates(datagrams: DataFrame) -> DataFrame:
    """exporter, domain, template_id, n_sets of data sets without a template."""
    none = with_templates(split_sets(datagrams)).where(F.col("fields").isNull())
    return none.groupBy("exporter", "domain", "template_id").agg(F.count(F.lit(1)).alias("n_sets"))

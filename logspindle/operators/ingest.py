"""HTTP-collector bodies (events, raw, NDJSON) and OpenTelemetry logs to one envelope table."""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from .json_streams import typed

COLUMNS = ["sourcetype", "host", "time", "received_at", "fields"]


def _split(bodies: DataFrame) -> DataFrame:
    """Adds the non-blank lines of each body; null where it isn't UTF-8."""
    text = F.when(F.is_valid_utf8("body"), F.col("body").cast("string"))
    return bodies.withColumn("__lines", F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.regexp_replace(x, r"\s", "") != ""))


def _whole(valid) -> Column:
    return F.coalesce(F.forall("__lines", lambda x: valid(F.try_parse_json(x))), F.lit(False))


def _lines(bodies: DataFrame, valid) -> DataFrame:
    """Non-blank lines of the bodies of which every line is ``valid``."""
    kept = _split(bodies).where(_whole(valid))
    return kept.select("*", F.posexplode("__lines").alias("line_no", "line")).withColumn("doc", F.try_parse_json("line")).drop("__lines")


def _at(received_at: Column | None) -> Column:
    return received_at if received_at is not None else F.current_timestamp()


def epoch_time(seconds: Column) -> Column:
    """To the microsecond; null beyond the years 1 to 9999."""
    whole = F.floor(seconds)
    micros = whole.cast("long") * 1_000_000 + F.floor((seconds - whole) * 1_000_000).cast("long")
    return F.when(seconds.between(-62_135_596_800, 253_402_300_799), F.timestamp_micros(micros))


def _has_event(d: Column) -> Column:
    keys = F.map_keys(F.try_variant_get(d, "$", "map<string,variant>"))
    return F.coalesce(d.isNotNull() & F.schema_of_variant(d).startswith("OBJECT") & F.array_contains(keys, "event"), F.lit(False))


def hec_rejected(bodies: DataFrame) -> DataFrame:
    """The bodies that ``hec_events`` leaves out whole; one without lines isn't among them."""
    return _split(bodies).where(~_whole(_has_event)).drop("__lines")


def hec_events(bodies: DataFrame, *, received_at: Column | None = None) -> DataFrame:
    """Rows from (body_id, body, default_sourcetype): an object with ``event`` a line. One bad line rejects its whole body."""
    rows = _lines(bodies, _has_event)
    doc = F.col("doc")
    return rows.select("body_id", "line_no", F.coalesce(typed(doc, "sourcetype", "str"), F.col("default_sourcetype")).alias("sourcetype"), typed(doc, "host", "str").alias("host"), epoch_time(typed(doc, "time", "f64")).alias("time"), _at(received_at).alias("received_at"), F.to_json(F.try_variant_get(doc, "$.event", "variant")).alias("fields"))


def hec_raw(bodies: DataFrame, *, received_at: Column | None = None) -> DataFrame:
    """One row a body, with its text (bad UTF-8 replaced) under ``raw``."""
    text = F.make_valid_utf8(F.col("body").cast("string"))
    return bodies.select("body_id", F.lit(0).alias("line_no"), F.col("default_sourcetype").alias("sourcetype"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("timestamp").alias("time"), _at(received_at).alias("received_at"), F.to_json(F.struct(text.alias("raw"))).alias("fields"))


def ndjson(bodies: DataFrame, *, received_at: Column | None = None) -> DataFrame:
    """Rows from any JSON value a line; the whole value is kept. One bad line rejects its whole body."""
    rows = _lines(bodies, lambda d: d.isNotNull())
    return rows.select("body_id", "line_no", F.col("default_sourcetype").alias("sourcetype"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("timestamp").alias("time"), _at(received_at).alias("received_at"), F.col("line").alias("fields"))


def _pick(o: dict, *names: str):
    return next((o[n] for n in names if o.get(n) is not None), None)


def any_value(v) -> object:
    """An OpenTelemetry AnyValue (JSON form) as plain JSON."""
    if not isinstance(v, dict):
        return None
    for kind, x in v.items():
        k = kind.replace("_", "").lower()
        if k == "intvalue":
            return int(x)
        if k == "doublevalue":
            return float(x) if math.isfinite(float(x)) else None
        if k == "bytesvalue":
            return x.hex() if isinstance(x, bytes) else base64.b64decode(x).hex()
        if k == "arrayvalue":
            return [any_value(i) for i in x.get("values") or []]
        if k == "kvlistvalue":
            return key_values(x.get("values"))
        if k in ("stringvalue", "boolvalue"):
            return x
    return None


def key_values(pairs) -> dict:
    return {p.get("key", ""): any_value(p.get("value")) for p in pairs or []}


def otlp_records(request: dict) -> Iterator[tuple[int | None, dict]]:
    """(time in nanoseconds, fields) of each log record; of equal keys the one nearest to the record counts."""
    for resource in _pick(request, "resourceLogs", "resource_logs") or []:
        outer = key_values((resource.get("resource") or {}).get("attributes"))
        for scope in _pick(resource, "scopeLogs", "scope_logs") or []:
            middle = key_values((scope.get("scope") or {}).get("attributes"))
            for log in _pick(scope, "logRecords", "log_records") or []:
                fields = {**outer, **middle, **key_values(log.get("attributes"))}
                if log.get("body") is not None:
                    fields["body"] = any_value(log["body"])
                text, number = _pick(log, "severityText", "severity_text"), _pick(log, "severityNumber", "severity_number")
                if text:
                    fields["severity_text"] = text
                if number:
                    fields["severity_number"] = int(number)
                for name, value in (("trace_id", _pick(log, "traceId", "trace_id")), ("span_id", _pick(log, "spanId", "span_id"))):
                    if value:
                        fields[name] = value
                nanos = int(_pick(log, "timeUnixNano", "time_unix_nano") or 0)
                yield (nanos if 0 < nanos < 1 << 63 else None), fields


# Field numbers of the protobuf messages, as (name, kind) by message.
_MESSAGES = {
    "request": {1: ("resourceLogs", "resource_logs")},
    "resource_logs": {1: ("resource", "attributes"), 2: ("scopeLogs", "scope_logs")},
    "scope_logs": {1: ("scope", "scope"), 2: ("logRecords", "record")},
    "attributes": {1: ("attributes", "pair")},
    "scope": {3: ("attributes", "pair")},
    "record": {1: ("timeUnixNano", "fixed"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "value"), 6: ("attributes", "pair"), 9: ("traceId", "hex"), 10: ("spanId", "hex")},
    "pair": {1: ("key", "text"), 2: ("value", "value")},
    "value": {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "signed"), 4: ("doubleValue", "double"), 5: ("arrayValue", "array"), 6: ("kvlistValue", "list"), 7: ("bytesValue", "bytes")},
    "array": {1: ("values", "value")},
    "list": {1: ("values", "pair")},
}
_MANY = {"resourceLogs", "scopeLogs", "logRecords", "attributes", "values"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def from_protobuf(data: bytes, message: str = "request") -> dict:
    """The JSON form of a protobuf message, by ``_MESSAGES``; unknown fields are skipped."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        else:
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated")
            raw, at = data[at : at + size], at + size
        name, kind = _MESSAGES[message].get(tag >> 3, (None, None))
        if name is None:
            continue
        if kind in _MESSAGES:
            value = from_protobuf(raw, kind)
        elif kind == "text":
            value = raw.decode("utf-8")
        elif kind == "hex":
            value = raw.hex()
        elif kind == "fixed":
            value = struct.unpack("<Q", raw)[0]
        elif kind == "double":
            value = struct.unpack("<d", raw)[0]
        elif kind == "bool":
            value = bool(raw)
        elif kind == "signed":
            value = raw - (1 << 64) if raw >> 63 else raw
        else:
            value = raw
        if name in _MANY:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


_BAD = (ValueError, IndexError, KeyError, AttributeError, TypeError)


def _decoded(body: bytes | None, kind: str | None) -> list:
    """The records of a body; an error if it is malformed, none if its kind isn't known."""
    kind = (kind or "").split(";")[0].strip().lower()
    if kind not in ("application/json", "application/x-protobuf"):
        return []
    return list(otlp_records(json.loads(body) if kind == "application/json" else from_protobuf(body or b"")))


def otlp_rejected(bodies: DataFrame) -> DataFrame:
    """body_id and status of the bodies that ``otlp_logs`` doesn't read: 415 for an unknown content type, 400 for a malformed body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for body_id, body, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    _decoded(body, kind)
                except _BAD:
                    bad.append(body_id)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64()), pa.array([400] * len(bad), pa.int32())], ["body_id", "status"])

    known = F.coalesce(F.lower(F.trim(F.substring_index("content_type", ";", 1))).isin("application/json", "application/x-protobuf"), F.lit(False))
    odd = bodies.where(~known).select(F.col("body_id").cast("long"), F.lit(415).alias("status"))
    return odd.unionByName(map_arrow(bodies.where(known).select(F.col("body_id").cast("long"), F.col("body").cast("binary"), "content_type"), run, "body_id long, status int"))


def otlp_logs(bodies: DataFrame, *, received_at: Column | None = None) -> DataFrame:
    """Rows from (body_id, body, content_type, source_host); a body that can't be decoded gives none.

    ``application/json`` and ``application/x-protobuf`` bodies are read; bodies of other kinds, or of none, are not (``otlp_rejected``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body_id, body, kind, host in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    got = _decoded(body, kind)
                except _BAD:
                    continue
                rows += [(body_id, i, host, None if t is None else t // 1000, json.dumps(f, ensure_ascii=False, sort_keys=True)) for i, (t, f) in enumerate(got)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)], ["body_id", "line_no", "host", "micros", "fields"])

    source = bodies.select(F.col("body_id").cast("long"), F.col("body").cast("binary"), "content_type", "source_host")
    out = map_arrow(source, run, "body_id long, line_no int, host string, micros long, fields string")
    return out.select("body_id", "line_no", F.lit("otlp").alias("sourcetype"), "host", F.timestamp_micros("micros").alias("time"), _at(received_at).alias("received_at"), "fields")

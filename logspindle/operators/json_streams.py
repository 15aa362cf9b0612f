"""Zeek and Suricata JSON lines to typed tables with an overflow column, table-driven on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rfc3339_text

_COMMON = ["ts:f64", "uid:str", "id.orig_h:str", "id.orig_p:u16", "id.resp_h:str", "id.resp_p:u16"]
# Keys and types of the typed tables; columns have _ for the keys' dots.
TABLES = {
    "conn": [*_COMMON, "proto:str", "service:str", "duration:f64", "orig_bytes:u64", "resp_bytes:u64", "conn_state:str", "history:str", "orig_pkts:u64", "resp_pkts:u64"],
    "dns": [*_COMMON, "proto:str", "trans_id:u32", "query:str", "qtype_name:str", "qclass_name:str", "rcode_name:str", "answers:list"],
    "http": [*_COMMON, "method:str", "host:str", "uri:str", "status_code:u16", "user_agent:str", "request_body_len:u64", "response_body_len:u64"],
    "ssl": [*_COMMON, "version:str", "cipher:str", "curve:str", "server_name:str", "validation_status:str"],
    "files": ["ts:f64", "fuid:str", "tx_hosts:list", "rx_hosts:list", "source:str", "mime_type:str", "filename:str", "total_bytes:u64"],
    "notice": [*_COMMON, "note:str", "msg:str", "sub:str", "actions:list"],
}
_MOST = {"u16": (65535, "int"), "u32": (4294967295, "long"), "u64": (18446744073709551615, "decimal(20,0)")}


def typed(doc: Column, key: str, kind: str) -> Column:
    """The value of a top-level key if it has the JSON type that ``kind`` asks for, else null."""
    raw = F.try_variant_get(doc, f'$["{key}"]', "variant")
    shape = F.schema_of_variant(raw)
    if kind == "str":
        return F.when(shape == "STRING", F.try_variant_get(doc, f'$["{key}"]', "string"))
    if kind == "f64":
        return F.when(shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), F.try_variant_get(doc, f'$["{key}"]', "double"))
    if kind == "list":
        return F.when((shape == "STRING") | shape.startswith("ARRAY"), F.to_json(raw))
    most, cast = _MOST[kind]
    # a DECIMAL of 19 or 20 digits without fraction is a whole number beyond BIGINT; shorter ones were written like 80.0
    whole = (shape == "BIGINT") | shape.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
    value = F.try_variant_get(doc, f'$["{key}"]', "decimal(20,0)")
    return F.when(whole & (value >= 0) & (value <= F.lit(str(most)).cast("decimal(20,0)")), value.cast(cast))


def parse_lines(lines: DataFrame, route_key: str, col: str = "value", *, max_bytes: int = 16 << 20) -> DataFrame:
    """Adds doc (variant) and route (the text under ``route_key``, else ``unknown``); oversize and bad lines are left out."""
    out = lines.where(F.octet_length(col) <= max_bytes).withColumn("doc", F.try_parse_json(col)).where(F.col("doc").isNotNull())
    return out.withColumn("route", F.coalesce(typed(F.col("doc"), route_key, "str"), F.lit("unknown")))


def rejected_lines(lines: DataFrame, col: str = "value", *, max_bytes: int = 16 << 20) -> DataFrame:
    """The lines that ``parse_lines`` leaves out, with reason: ``oversize`` or ``malformed``. Blank lines are neither."""
    reason = F.when(F.octet_length(col) > max_bytes, "oversize").when(F.try_parse_json(col).isNull(), "malformed")
    return lines.where(F.trim(col) != "").withColumn("reason", reason).where(F.col("reason").isNotNull())


def zeek_table(parsed: DataFrame, log_path: str) -> DataFrame:
    """The rows of one typed table: those with exactly that path. A path that only becomes the table's name when it is cleaned
    (``Conn``) is for the envelope. What has no column, and what has the wrong type for it, goes to ``_extra`` as JSON."""
    fields = [f.split(":") for f in TABLES[log_path]]
    rows = parsed.where(F.col("route") == log_path)
    staged = rows.withColumns({k.replace(".", "_"): typed(F.col("doc"), k, kind) for k, kind in fields})
    whole = F.try_variant_get("doc", "$", "map<string,variant>")
    taken = F.create_map(*[x for k, _ in fields for x in (F.lit(k), F.col(k.replace(".", "_")).isNotNull())])
    rest = F.map_filter(whole, lambda k, v: ~F.coalesce(F.try_element_at(taken, k), F.lit(False)))
    return staged.select(*[k.replace(".", "_") for k, _ in fields], F.to_json(rest).alias("_extra"))


def zeek_envelope(parsed: DataFrame, *, ingest_time: Column | None = None, col: str = "value") -> DataFrame:
    """The rows of all other streams, with the whole line as payload."""
    at = ingest_time if ingest_time is not None else F.current_timestamp()
    rows = parsed.where(~F.col("route").isin(list(TABLES)))
    common = [typed(F.col("doc"), *f.split(":")).alias(f.split(":")[0].replace(".", "_")) for f in _COMMON]
    return rows.select(*common, F.col("route").alias("log_path"), rfc3339_text(at).alias("ingest_time"), F.col(col).alias("payload"))


def suricata_table(parsed: DataFrame, *, received_at: Column | None = None, col: str = "value") -> DataFrame:
    at = received_at if received_at is not None else F.current_timestamp()
    return parsed.select(F.col("route").alias("event_type"), rfc3339_text(at).alias("received_at"), typed(F.col("doc"), "src_ip", "str").alias("src_ip"), F.col(col).alias("payload"))


def diff(old: Column, new: Column) -> Column:
    """array<struct<key, status>> of two JSON objects' top-level keys: changed, added, removed or unchanged."""
    a, b = (F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for c in (old, new))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    text = lambda m, k: F.to_json(F.try_element_at(m, k))
    has = lambda m, k: F.array_contains(F.map_keys(m), k)
    state = lambda k: F.when(~has(a, k), "added").when(~has(b, k), "removed").when(text(a, k) == text(b, k), "unchanged").otherwise("changed")
    return F.transform(keys, lambda k: F.struct(k.alias("key"), state(k).alias("status")))

"""The counters of each kind of input, every one from a single pass: metric, label (null where it has none), value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest, payload, syslog
from .json_streams import typed

MAX_LINE = 256 << 10
#: Route key, counter of records without it, and counter by its value.
STREAMS = {"zeek": ("_path", "missing_path", "records_by_path"), "suricata": ("event_type", "missing_event_type", "records_by_event_type")}


def tally(rows: DataFrame, marks: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """How many rows meet each condition; of a pair, by the value of its second part. Counters that stay at 0 have no row."""
    of = lambda name, mark: F.struct(F.lit(name).alias("metric"), (mark[1] if isinstance(mark, tuple) else F.lit(None)).cast("string").alias("label"))
    each = [F.when(mark[0] if isinstance(mark, tuple) else mark, of(name, mark)) for name, mark in marks.items()]
    # exploded, so that each row is parsed once and summed up before the shuffle
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("m")).groupBy("m.metric", "m.label").agg(F.count(F.lit(1)).alias("value"))


def syslog_counters(lines: DataFrame, col: str = "value", *, year: Column | int | None = None, max_bytes: int = MAX_LINE) -> DataFrame:
    """Lines received, too long, or in no format, and payloads by their type. Null lines count nowhere."""
    fits = F.octet_length(col) <= max_bytes
    rows = payload.dispatch(syslog.parse_syslog(lines.withColumn("__fits", fits).withColumn(col, F.when(F.col("__fits"), F.col(col))), col, year=year))
    read, parsed = F.col("__fits"), F.col("protocol").isNotNull()
    return tally(rows, {
        "syslog_messages_received": read, "syslog_oversized_lines": ~read, "syslog_parse_errors": read & ~parsed,
        "syslog_payload_parsed": (read & parsed & F.col("payload_type").isNotNull(), F.col("payload_type")),
    })


def stream_counters(lines: DataFrame, stream: str, col: str = "value", *, max_bytes: int = 16 << 20) -> DataFrame:
    """The same of ``zeek`` or ``suricata`` lines: records by route, those without one, lines that are too long or not JSON. Empty and null lines count nowhere."""
    key, missing, by = STREAMS[stream]
    rows = lines.where(F.col(col) != "").withColumn("__fits", F.octet_length(col) <= max_bytes)
    rows = rows.withColumn("__doc", F.when(F.col("__fits"), F.try_parse_json(col)))
    route, read = typed(F.col("__doc"), key, "str"), F.col("__doc").isNotNull()
    return tally(rows, {
        f"{stream}_oversized_lines": ~F.col("__fits"), f"{stream}_parse_errors": F.col("__fits") & ~read, f"{stream}_records_received": read,
        f"{stream}_{missing}": read & route.isNull(), f"{stream}_{by}": (read, F.coalesce(route, F.lit("unknown"))),
    })


def hec_counters(bodies: DataFrame) -> DataFrame:
    """Events of the bodies that are taken, and bodies that are refused for one of their lines."""
    got = tally(ingest.hec_events(bodies), {"hec_events_received": F.lit(True)})
    return got.unionByName(tally(ingest.hec_rejected(bodies), {"hec_parse_errors": F.lit(True)}))


def together(*counters: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, counters)

"""Partitioned Parquet output, in batch and from streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rfc3339_text, sanitize_segment
from ..operators import ingest, syslog
from ..operators.json_streams import TABLES, suricata_table, zeek_envelope, zeek_table
from ..operators.payload import structured_records
from ..operators.route import cap_partitions, with_date
from ..operators.sflow import counter_table, flow_table
from ..operators.windows_events import to_table


def write_table(rows: DataFrame, prefix: str, segment: str | None = None, *, at: Column | None = None, partition_by: tuple[str, ...] = (), max_rows_per_file: int = 0) -> None:
    """Appends to ``prefix/segment/year=/month=/day=`` as ZSTD Parquet; the date is that of writing unless ``at`` is given."""
    path = "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate([prefix, segment or ""]) if p)
    writer = with_date(rows, at).write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", max_rows_per_file)
    writer.partitionBy(*partition_by, "year", "month", "day").parquet(path)


def write_zeek(parsed: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """One table for each typed stream, one with the rest under ``log_path=``."""
    for name in TABLES:
        write_table(zeek_table(parsed, name), prefix, name, at=at)
    rest = zeek_envelope(parsed).withColumn("segment", sanitize_segment(F.col("log_path")))
    write_table(rest, prefix, at=at, partition_by=("segment",))


def write_suricata(parsed: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    rows = suricata_table(parsed).withColumn("segment", sanitize_segment(F.col("event_type")))
    write_table(rows, prefix, at=at, partition_by=("segment",))


def write_syslog(parsed: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """Parsed syslog rows, without lines that no format fits; structured data as JSON."""
    rows = parsed.where(F.col("protocol").isNotNull()).select(*syslog.COLUMNS).withColumn("structured_data", F.to_json("structured_data"))
    write_table(rows.withColumn("timestamp", rfc3339_text(F.col("timestamp"))), prefix, at=at)


def write_structured(parsed: DataFrame, prefix: str, *, received_at: Column | None = None, at: Column | None = None) -> None:
    """The payloads of syslog rows, by ``payload_type=``."""
    write_table(structured_records(parsed, received_at), prefix, at=at, partition_by=("payload_type",))


def write_flows(flows: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """Flow rows as ``decode_datagrams`` gives them."""
    write_table(flows.drop("seq", "part", "record_no"), prefix, at=at)


def write_sflow(decoded: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """A table of flow samples and one of counter samples."""
    write_table(flow_table(decoded).drop("seq", "sample_no"), prefix, "flow", at=at)
    write_table(counter_table(decoded).drop("seq", "sample_no"), prefix, "counter", at=at)


def write_events(events: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """Windows events by ``event_id=``."""
    write_table(to_table(events), prefix, at=at, partition_by=("event_id",))


def write_generic(rows: DataFrame, prefix: str, *, at: Column | None = None) -> None:
    """Rows of HTTP-collector, NDJSON and OpenTelemetry bodies, by ``segment=``: the sourcetype, cleaned for paths."""
    write_table(rows.select(*ingest.COLUMNS, sanitize_segment(F.col("sourcetype")).alias("segment")), prefix, at=at, partition_by=("segment",))


def write_capped(rows: DataFrame, prefix: str, key: str, seq: str, most: int, *, at: Column | None = None) -> None:
    """By ``segment=``: the first ``most`` values of ``key``, cleaned for paths, then ``_overflow``."""
    capped = cap_partitions(rows.withColumn("__segment", sanitize_segment(F.col(key))), "__segment", seq, most).drop("__segment")
    write_table(capped, prefix, at=at, partition_by=("segment",))


def stream_to(rows: DataFrame, write, checkpoint: str, *, every: str | None = None):
    """Starts a query that calls ``write(batch)`` for each batch; without ``every`` it ends when what is there is done."""
    starter = rows.writeStream.option("checkpointLocation", checkpoint)
    starter = starter.trigger(processingTime=every) if every else starter.trigger(availableNow=True)

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            write(batch)
        finally:
            batch.unpersist()

    return starter.foreachBatch(each).start()

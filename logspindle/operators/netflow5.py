"""NetFlow v5 datagrams with SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import be_uint, ipv4

HEADER, RECORD = 24, 48


def decode_netflow_v5(datagrams: DataFrame) -> DataFrame:
    """Flow rows from (payload, exporter, seq); datagrams of other versions or cut short give none."""
    data = F.col("payload")
    count = be_uint(data, 2, 2)
    good = datagrams.where((F.length(data) >= HEADER) & (be_uint(data, 0, 2) == 5)).withColumn("__n", count)
    good = good.where((F.col("__n") > 0) & (F.length(data) >= HEADER + RECORD * F.col("__n")))
    each = good.select("*", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)).alias("record_no"))
    at = lambda off: F.lit(HEADER + off) + F.col("record_no") * RECORD
    u = lambda off, size: be_uint(data, at(off), size)
    extra = F.to_json(F.struct(u(28, 4).alias("flowEndSysUpTime"), u(24, 4).alias("flowStartSysUpTime")))
    none = lambda t: F.lit(None).cast(t)
    return each.select(
        "seq", "record_no", F.lit(0).cast("long").alias("observation_domain_id"), F.lit(0).alias("template_id"), F.lit(5).alias("protocol_version"), "exporter",
        F.timestamp_seconds(be_uint(data, 8, 4)).alias("export_time"), ipv4(data, at(0)).alias("src_addr"), ipv4(data, at(4)).alias("dst_addr"),
        u(32, 2).cast("int").alias("src_port"), u(34, 2).cast("int").alias("dst_port"), u(38, 1).cast("short").alias("ip_protocol"),
        u(20, 4).cast("decimal(20,0)").alias("octet_delta_count"), u(16, 4).cast("decimal(20,0)").alias("packet_delta_count"),
        none("timestamp").alias("flow_start"), none("timestamp").alias("flow_end"), u(37, 1).cast("short").alias("tcp_flags"),
        u(12, 2).alias("input_interface"), u(14, 2).alias("output_interface"), extra.alias("extra"),
    )

"""Throughput statistics over events: minute buckets, sliding sums, snapshots, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow

RETENTION_MINUTES = 60


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000)).cast("long")


def series(events: DataFrame, *, type_col: str = "event_type", ts_col: str = "ts") -> DataFrame:
    """event_type, minute (since the epoch), n."""
    return events.groupBy(F.col(type_col).alias("event_type"), minute_of(F.col(ts_col)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def sliding(per_minute: DataFrame, minutes: int = 5) -> DataFrame:
    """Adds the sum over each bucket and those ``minutes - 1`` before it."""
    w = Window.partitionBy("event_type").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    return per_minute.withColumn("n_window", F.sum("n").over(w))


def retained(per_minute: DataFrame, as_of_minute: Column, minutes: int = RETENTION_MINUTES) -> DataFrame:
    return per_minute.where(F.col("minute") >= as_of_minute - minutes)


def snapshot(events: DataFrame, as_of: Column, *, type_col: str = "event_type", ts_col: str = "ts") -> DataFrame:
    """Total, the current calendar minute, the last five, and the current minute's average a second, by type; busiest first."""
    now, minute = minute_of(as_of), minute_of(F.col(ts_col))
    last = lambda k: F.count_if((minute <= now) & (minute > now - k))
    out = events.groupBy(F.col(type_col).alias("event_type")).agg(F.count(F.lit(1)).alias("total_events"), last(1).alias("last_minute"), last(5).alias("last_five_minutes"))
    return out.withColumn("average_per_second_last_minute", F.col("last_minute") / 60.0).orderBy(F.desc("last_minute"), "event_type")


def counters(rows: DataFrame, name: str, *labels: str) -> DataFrame:
    """metric, its labels and value: a counter of ``rows``."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), *labels, "value")


def latest(entries: DataFrame, n: int, ts_col: str = "timestamp", *ties: str) -> DataFrame:
    return entries.orderBy(F.desc(ts_col), *ties).limit(n)


def totals(events: DataFrame, *distinct: str) -> DataFrame:
    """n_events, and the number of different values of each given column as n_<column>s."""
    return events.agg(F.count(F.lit(1)).alias("n_events"), *[F.countDistinct(c).alias(f"n_{c}s") for c in distinct])


def fixed_window_limit(requests: DataFrame, *, key: str = "ip", ts_col: str = "ts", ties: tuple[str, ...] = (), seconds: int = 60, most: int = 30) -> DataFrame:
    """Adds allowed: whether a request is among the first ``most`` of its key's window of ``seconds`` (calendar windows); ``ties`` order requests of one time."""
    w = Window.partitionBy(key, F.window(F.col(ts_col).cast("timestamp"), f"{seconds} seconds")).orderBy(ts_col, *ties)
    return requests.withColumn("allowed", F.row_number().over(w) <= most)


def anchored_window_limit(requests: DataFrame, *, key: str = "ip", ts_col: str = "ts", ties: tuple[str, ...] = (), seconds: int = 60, most: int = 30) -> DataFrame:
    """As ``fixed_window_limit``, with windows that begin at a request: the key's first one, then the first more than ``seconds`` after
    the last window's beginning. Requests without a time get null. A key's requests are read in order by one task, as a stream."""
    micros = f"__{ts_col}_micros"
    rows = requests.withColumn(micros, F.unix_micros(F.col(ts_col).cast("timestamp"))).repartition(key).sortWithinPartitions(key, micros, *ties)
    width = seconds * 1_000_000

    def scan(batches: Iterator) -> Iterator:
        now, start, n = (), None, 0
        for batch in batches:
            flags: list = []
            for k, at in zip(batch.column(key).to_pylist(), batch.column(micros).to_pylist(), strict=True):
                if at is None:
                    flags.append(None)
                    continue
                if (k,) != now:
                    now, start = (k,), None
                if start is None or at - start > width:
                    start, n = at, 0
                n += 1
                flags.append(n <= most)
            kept = [batch.column(c) for c in requests_columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(flags, pa.bool_())], [*requests_columns, "allowed"])

    requests_columns = requests.columns
    return map_arrow(rows, scan, T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())]))

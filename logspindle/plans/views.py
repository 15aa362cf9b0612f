"""Output tables as temporary views for free-form SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register(**tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)

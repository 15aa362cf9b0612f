"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch at most: texts of some kilobytes make batches of some megabytes, in the JVM and in Python.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Bytes of batches after which a worker hands freed memory back.
TRIM_BYTES = 128 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="logspindle-"), "logspindle_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: What a Python worker keeps between tasks, for the kind of task that asked for it last.
_kept: dict[str, object] = {}


def kept(key: str, make):
    """``make()``, or what it gave to an earlier task of this worker; tasks of another kind let it go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Returns freed memory to the system: idle workers and the JVM share an executor's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, function, schema, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on the executors, and lean workers. ``keeps``: the key of what the function keeps."""
    spark = df.sparkSession
    ship(spark)
    for name, most in _LIMITS.items():  # read when the plan runs, so they stay set
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))

    def run(batches):
        if _kept and keeps not in _kept:
            _kept.clear()

        def each():
            seen = 0
            for batch in batches:
                seen += batch.nbytes
                yield batch
                del batch
                if seen > TRIM_BYTES:
                    seen = 0
                    trim()

        yield from function(each())
        trim()

    return df.mapInArrow(run, schema)

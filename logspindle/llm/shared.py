"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow

#: Keys of more rows than this, and than a 2**20th of all rows, are joined by broadcast: at most 2**20 keys.
HOT = 64
#: On a local disk and without native libraries, Hadoop starts a ``chmod`` for each folder and file it makes, and three more for a file
#: with a checksum file; while one is being started, it has its executor's whole memory beside the executor. So intermediate tables are
#: written there without checksum files (their pages have checksums of their own) and without a ``_SUCCESS``. Other file systems don't know the first two.
_WRITE = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "parquet.page.write-checksum.enabled": "true",
}
_READ = {"parquet.page.verify-checksum.enabled": "true"}
#: A step over stored tables is written in a file for each 2**25 of their bytes, and in ``WAVES`` files for each core if that is more.
FILE_BITS, WAVES = 25, 2
#: Bytes of a row group that a Python worker writes.
GROUP_BYTES = 16 << 20
#: Types that Spark reads from a Python worker's files as they were.
_PLAIN = (T.LongType, T.IntegerType, T.BooleanType, T.DoubleType, T.StringType, T.BinaryType)


def folder(spark: SparkSession) -> str:
    """The application's own folder under ``spark.checkpoint.dir``. Only a local master does without that setting, with one in the temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="logspindle-checkpoints-"))
    return context.getCheckpointDir()


def spare(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _stored(df: DataFrame):
    """The settled table's path and file system."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._settled_at)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _fewer(df: DataFrame, of: list[DataFrame] | None) -> DataFrame:
    if not of or not all(getattr(x, "_settled_at", None) for x in of):
        return df
    held = sum(fs.getContentSummary(at).getLength() for at, fs in map(_stored, of))
    return df.coalesce(max(WAVES * df.sparkSession.sparkContext.defaultParallelism, held >> FILE_BITS))


def settle(df: DataFrame, of: list[DataFrame] | None = None, **options) -> DataFrame:
    """``df`` written (with ``options``) to a table in the shared folder and read from there: its lineage ends, and lost executors cost nothing.

    ``of``: the tables that ``df`` is made of; where all are settled, it is written in few files, as their bytes allow, however many partitions it has.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df = _fewer(df, of)
    df.write.options(**_WRITE, **options).parquet(path)
    out = spark.read.schema(df.schema).options(**_READ).parquet(path)
    out._settled_at = path
    return out


def _plain(kind: T.DataType) -> bool:
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _PLAIN)


def store(df: DataFrame, of: list[DataFrame] | None = None) -> DataFrame:
    """``settle(df, of)``; on a local disk by the Python workers, so that no process is started for a file.

    A task writes a hidden file and gives its name; the driver shows those of the tasks that counted, so a task that runs again leaves nothing in the table.
    """
    spark = df.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = fs.makeQualified(base).toUri()
    if uri.getScheme() != "file" or not all(_plain(f.dataType) for f in df.schema.fields):
        return settle(df, of)
    path = f"{uri.getPath()}/{uuid.uuid4().hex}"
    os.makedirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        name, file, group, size = uuid.uuid4().hex + ".parquet", None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                file = file or pq.ParquetWriter(f"{path}/.{name}", batch.schema, compression="snappy", write_page_checksum=True)
                file.write_table(pa.Table.from_batches(group))
                group, size = [], 0
        if group:
            file = file or pq.ParquetWriter(f"{path}/.{name}", group[0].schema, compression="snappy", write_page_checksum=True)
            file.write_table(pa.Table.from_batches(group))
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    for r in map_arrow(_fewer(df, of), run, "name string").collect():
        os.rename(f"{path}/.{r.name}", f"{path}/{r.name}")
    out = spark.read.schema(df.schema).options(**_READ).parquet(f"file://{path}")
    out._settled_at = f"file://{path}"
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a settled table that nothing will read again."""
    if getattr(df, "_settled_at", None):
        path, fs = _stored(df)
        fs.delete(path, True)


def join_hot(rows: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with the stored ``stats`` (a row for each key, with the number of its rows), without all rows of a large key in one task.

    Keys with more than ``HOT`` rows and more than a 2**20th of all rows are joined by broadcast: there can't be more than 2**20.
    """
    most = max(HOT, (stats.agg(F.sum(size)).first()[0] or 0) >> 20)
    hot = F.broadcast(stats.where(F.col(size) > most))
    cool = rows.join(hot.select(*keys), keys, "left_anti").join(stats.where(F.col(size) <= most), keys)
    return cool.unionByName(rows.join(hot, keys))

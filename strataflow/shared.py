"""Tables written to the folder that all executors share, to cut the lineage of iterative plans.

The folder is the session's ``spark.checkpoint.dir``. Only a session whose master is local may leave it
unset: then a local one is used. A written table survives the loss of executors. ``tidy`` deletes an
operator's tables, but for those that its result reads.
"""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Spark's own setting: the shuffle files of an execution are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: scan partitions that a task takes where their results are small, so that tables are not cut into very small files
PACK = 8
#: bytes of a row group of a written table, which its writer and a part of its readers hold on the heap
ROW_GROUP = 16 << 20
_local = threading.local()


def _open() -> list[list[str]]:
    """Paths written by each tidy() call that is running in this thread, the innermost last."""
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or f"{tempfile.gettempdir()}/strataflow-shared").rstrip("/")


def write(df: DataFrame, name: str, codec: str = "lz4_raw") -> str:
    """Write ``df`` as Parquet to a fresh path in the shared folder and return the path.

    Nothing reads the shuffle files behind it again, so they are deleted at once.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/strataflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _open():
        _open()[-1].append(path)
    return path


def tasks(df: DataFrame, pack: int = PACK) -> int:
    """How many tasks, and so files, a table derived from all of ``df`` is worth: ``pack`` full scan partitions each, two a core at least."""
    spark = df.sparkSession
    unit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * spark.sparkContext.defaultParallelism, min(-(-size // (pack * unit)), 1 << 20))


def cut(df: DataFrame, name: str = "step", narrow: bool = False, files: int | None = None, codec: str = "lz4_raw") -> DataFrame:
    """The same rows, read back from a written table of at most ``files`` files.

    ``narrow``: the rows are far fewer and smaller than the input; they go to one file a core at most.
    ``codec``: zstd makes large tables of texts smaller, at the price of time.
    """
    spark = df.sparkSession
    files = spark.sparkContext.defaultParallelism if narrow else files
    path = write(df if files is None else df.coalesce(max(1, files)), name, codec)
    out = read(spark, path, df.schema)
    out._written_to = path
    return out


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table that write() left at ``path``.

    Parquet's dictionary filter takes a dictionary in pieces of 8 KB, which its lz4_raw decompressor cannot give: a pushed-down comparison
    with a column of more than 1,024 different numbers would fail. Row groups are skipped by their statistics only.
    """
    reader = spark.read.option("parquet.filter.dictionary.enabled", "false")
    return (reader if schema is None else reader.schema(schema)).parquet(path)


#: bytes of a part of placed(), as its written table is counted: at most, and with which placing pays
PART, LEAST_PART = 16 << 20, 1 << 20


def placed(df: DataFrame, key: str) -> DataFrame:
    """``df``, a written table, in sorted parts by ``key`` on the executors' disks: joins on the key neither move nor sort it again.

    Parts are as many as its size asks for, so that a task's memory does not grow with it; a small table is left as it is, and adaptive
    execution joins it in few tasks. The caller unpersists it.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size < least * LEAST_PART:
        return df
    parts = max(least, min(-(-size // PART), 1 << 16))
    return df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)


def drop(*tables: DataFrame) -> None:
    """Delete those of the DataFrames that cut() returned; nothing may read them afterwards."""
    for t in tables:
        if getattr(t, "_written_to", None):
            remove(t.sparkSession, t._written_to)


def save_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a small file beside ``path`` and rename it over that, so that readers see the old value or the new one."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(conf)
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(old), options)


def load_json(spark: SparkSession, path: str) -> object | None:
    """What save_json() wrote; None where there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def tidy(f: Callable) -> Callable:
    """Deletes the tables that ``f`` writes once it returns, but for those that the DataFrames it returns read."""

    @wraps(f)
    def run(*args, **kwargs):
        _open().append([])
        spark, kept = SparkSession.getActiveSession(), []
        try:
            out = f(*args, **kwargs)
            results = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            read = {part for x in results for file in x.inputFiles() for part in file.split("/")}
            kept = [p for p in _open()[-1] if p.rsplit("/", 1)[-1] in read]
            spark = results[0].sparkSession if results else spark
            return out
        finally:
            for path in set(_open().pop()).difference(kept):
                remove(spark, path)
            if _open():
                _open()[-1].extend(kept)

    return run


def broadcast_if_small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """``df`` with a broadcast hint when it is counted to have few rows; otherwise as it is, for a shuffled join.

    For narrow tables that are cheap to count, such as written ones.
    """
    return F.broadcast(df) if df.count() <= rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)

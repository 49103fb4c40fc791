"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII separators (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, where none is configured, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = getattr(spark, "_seamark_scratch", None)
    if where is None:
        where = tempfile.mkdtemp(prefix="seamark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark._seamark_scratch = where
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete what materialise wrote, once nothing reads it any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total bytes of text, for sizing only; no result depends on it."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def parts_for(total: float, each: float, least: int = 1, most: int = 200_000) -> int:
    return max(least, min(most, math.ceil(total / each)))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release() -> None:
    """Give freed memory back to the system; called where a task ends, as workers are kept for further tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def slices(batch, rows: int = 512):
    """Arrow batches in slices, so that one task holds few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def runs(batches, key: str):
    """Arrow batches that hold the rows of each key whole; rows arrive sorted by key."""
    import numpy as np

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[-1].column(key)[0].as_py() == keys[0]:
            held.append(batch)
            continue
        if last == 0:
            if held:
                yield _one(held)
            held = [batch]
            continue
        yield _one([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield _one(held)


def _one(batches):
    import pyarrow as pa

    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

"""Row numbers, running sums and ranks within keys, where one key may hold any share of the rows.

Rows are dealt by ranges of keys and order; sums of whole ranges, a row for each range and key that meets
it, tell where each range begins.  So no task holds more than a range, however few keys there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators.lineage import written


def _dealt(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], weight: str | None) -> DataFrame:
    """rows by range (_p), with the sums before the range (_n0, _s0) and of the whole key (_n, _s)."""
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    each = ranged.groupBy("_p", *keys).agg(F.count("*").alias("_k"), (F.sum(weight) if weight else F.lit(None).cast("double")).alias("_w"))
    whole = Window.partitionBy(*keys)  # as many rows as a key meets ranges
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    begins = each.select(F.col("_p").alias("_q"), *(F.col(k).alias(f"_key_{k}") for k in keys), zero(F.sum("_k").over(before), "bigint").alias("_n0"), F.sum("_k").over(whole).alias("_n"), zero(F.sum("_w").over(before), "double").alias("_s0"), F.sum("_w").over(whole).alias("_s"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_p") == F.col("_q"))
    return ranged.join(begins, same).drop("_q", *(f"_key_{k}" for k in keys))


def running(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """rows with rn, n and, for a weight, the sum up to each row (run) and of all (total), within keys by order."""
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    out = _dealt(rows, keys, order, weight).withColumn("rn", F.col("_n0") + F.row_number().over(w)).withColumnRenamed("_n", "n")
    if weight:
        out = out.withColumn("run", F.col("_s0") + F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumnRenamed("_s", "total")
    return out.drop("_p", "_n0", "_s0", "_s")


def ranks(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """rows with n, rank (the first place of equal values) and upto (their last); equal values share a range."""
    w = Window.partitionBy("_p", *keys).orderBy(value)
    got = _dealt(rows, keys, (value,), None).withColumn("rank", F.col("_n0") + F.rank().over(w)).withColumn("upto", F.col("_n0") + F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return got.withColumnRenamed("_n", "n").drop("_p", "_n0", "_s0", "_s")

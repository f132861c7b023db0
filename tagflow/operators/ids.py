"""Dense, gap-free ids in sort order without a single-partition window.

``orderBy`` range-partitions the rows; ``monotonically_increasing_id`` gives
(partition index, row index) pairs; the result is written once as a table in
the shared checkpoint folder (``spark.checkpoint.dir``) and read back, so those
pairs are fixed and the input is computed only once;
per-partition counts (one row per partition, a proven small bound) give
offsets that are broadcast back.  Everything else stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.session import scratch

_LOW_BITS = (1 << 33) - 1


def dense_index(df: DataFrame, order_cols: list, name: str = "idx", start: int = 0) -> DataFrame:
    """Add BIGINT ``name`` = start + rank of the row in ``order_cols`` order (ties broken by the sort)."""
    return dense_index_with_sums(df, order_cols, name, start, {})


def dense_index_with_sums(df: DataFrame, order_cols: list, name: str = "idx", start: int = 0,
                          sums: dict[str, Column] | None = None) -> DataFrame:
    """``dense_index`` plus, for each entry of ``sums``, the running sum of a column up to and with the row."""
    spark = df.sparkSession
    path = scratch(spark, "dense-index")
    mid = F.monotonically_increasing_id()
    sums = sums or {}
    (df.orderBy(*order_cols)
     .withColumn("_part", F.shiftright(mid, 33))
     .withColumn("_row", mid.bitwiseAND(F.lit(_LOW_BITS)))
     .write.parquet(path))
    ordered = spark.read.parquet(path)
    per = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    # one row per partition: a bounded table, so the global window and broadcast are safe
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ordered.select("*", *[F.sum(c).over(inside).alias(f"_run_{k}") for k, c in sums.items()]).join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.col("_off") + F.col("_row") + F.lit(start)).cast("long").alias(name),
                      *[(F.col(f"_off_{k}") + F.col(f"_run_{k}")).alias(k) for k in sums])


def file_order(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_block``, ``_seq``: sorting by them gives the order of the rows in the files read.

    A split of a file is read front to back by one task, so the row counter rises within (file, block start).
    """
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_seq"))


FILE_ORDER = ["_file", "_block", "_seq"]

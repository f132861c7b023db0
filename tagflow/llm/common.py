"""Helpers shared by the operators: scratch tables, let-binding, ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagflow.session import delete_path, scratch, ship_package

#: ASCII white space of the contracts (fixed value).
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\u000b\u000c\r"
WORD_RE = rf"[^{BLANK}]+"
BLANK_RE = rf"[{BLANK}]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return scratch(spark, f"llm-{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        delete_path(df.sparkSession, path)


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers (needed before any pandas/Arrow stage)."""
    ship_package(spark)
    return spark


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: a lambda variable is evaluated once, an inlined expression for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of maximal runs of non-blank characters; null or blank text gives an empty array."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RE)))


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (long), without keeping them."""
    return F.size(words_of(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """Seeded shuffle key of a row: md5 hex of the seed and the columns (null: the word null)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def cumulated(df: DataFrame, group: list[str], order: list[str], size: str | None, name: str) -> DataFrame:
    """Ranks and running sums within ``group`` in ``order``, without one task holding a group.

    The rows are range-sorted on ``group + order`` and written once with the number of their range
    partition; a window runs inside each (partition, group) and the offsets come from one row per
    (partition, group).  So a group with a third of all rows is spread over a third of the partitions.
    ``group`` columns must not be null; ``order`` should end in a tie-break.  Adds ``_rank`` (from 0),
    ``_count`` (rows of the group) and, with ``size``, ``_before`` and ``_total`` (running and full sum).
    """
    t = written(df.orderBy(*group, *order).withColumn("_part", F.spark_partition_id()), name)
    size_col = F.col(size) if size else F.lit(0).cast("long")
    w = Window.partitionBy("_part", *group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = t.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.sum(size_col).alias("_s"))
    # one row per range partition and group: a partition's groups sit side by side, so there are at most partitions + groups rows
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy("_part")
    full = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = per.select("_part", *group,
                      (F.sum("_n").over(before) - F.col("_n")).alias("_on"), F.sum("_n").over(full).alias("_count"),
                      (F.sum("_s").over(before) - F.col("_s")).alias("_os"), F.sum("_s").over(full).alias("_total"))
    ranked = t.select("*", (F.row_number().over(w) - 1).cast("long").alias("_r"),
                      (F.sum(size_col).over(run) - size_col).alias("_b"))
    out = ranked.join(offs, ["_part", *group])
    keep = [c for c in df.columns]
    extra = [(F.col("_on") + F.col("_r")).alias("_rank"), "_count"]
    if size:
        extra += [(F.col("_os") + F.col("_b")).alias("_before"), "_total"]
    return out.select(*keep, *extra)

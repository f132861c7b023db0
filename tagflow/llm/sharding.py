"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked there; a row's fractional rank
``(rank + 1/2) / rows of its source`` spreads every source evenly over [0, 1); the global order of the
fractional ranks is cut into ``n_shards`` runs whose lengths differ by one row at most.  Every shard
therefore holds each source in its share of the whole.

Defined cases: a null source is a stratum of its own; a null text has size 16 (no bytes); null ids hash
like the word null; repeated rows get a place each; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import cumulated, seeded, utf8_bytes

SHARD_OVERHEAD = 16


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, stratum, shard and gapless slot in it (law: rows)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"), (utf8_bytes(text) + SHARD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(stratum_col).isNull().alias("_none"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_src"),
        seeded(seed, F.col(id_col)).alias("_key"))
    tie = ["_key", "doc_id", "text_crc32", "size"]
    within = cumulated(light, ["_none", "_src"], tie, None, "shard-strata")
    spread = within.select(*light.columns, ((F.col("_rank") + F.lit(0.5)) / F.col("_count")).alias("_frac"))
    placed = cumulated(spread, [], ["_frac", "_none", "_src", *tie], None, "shard-order")
    first = F.expr(f"(shard * _count + {n_shards - 1}) div {n_shards}")  # smallest global rank of the shard
    return (placed.withColumn("shard", F.expr(f"(_rank * {n_shards}) div _count"))
            .withColumn("slot", F.col("_rank") - first)
            .select("doc_id", "size", "text_crc32", F.when(~F.col("_none"), F.col("_src")).alias("source"),
                    F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")))

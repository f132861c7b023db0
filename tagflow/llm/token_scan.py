"""Token counts of flat unindexed token files by a separator scan.

A token file is nothing but ids of fixed width in a row, documents ended by the end-of-document id.  It is read in blocks of a
fixed number of ids, cut without regard to documents.  Each block is searched for the end id in one vectorised comparison and gives
what it knows: the documents that end in it, the ids behind the last end.  A prefix scan over the blocks of a file (a
window of running sums, one row per block) carries the open document's ids and the number of documents over the block's edge, so that
every document gets its number in the file, its start and its ids, however many blocks it spans.

The files written here end documents by ``SEPARATOR``, which must not be an id of any text; an encoded id equal to it
fails the job.  Ids of ordinary pieces (1 is a quotation mark in the default vocabulary) can't separate documents.

Defined cases: an empty file has no documents; ids behind the last end of a file are a document without an end (``ended`` false); two ends
in a row are an empty document; a null or empty text is one end id; repeated rows are documents each; null ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.llm.common import prepared, written
from tagflow.llm.tokens import DEFAULT_TOKENIZER, ChunkEncoder, text_groups

BLOCK_IDS, END_ID = 1 << 18, 1
#: End of a document in files written here: the last id of two bytes, above every id of the default vocabulary (49,408 ids).
SEPARATOR = (1 << 16) - 1


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids) of the flat files below ``path``, ids being ``width`` bytes each (2 or 4, little endian).

    One file is one row of Spark's binary reader first, so a file may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    size = block_ids * width
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).otherwise(F.array().cast("array<bigint>"))
    return files.withColumn("block", F.explode(starts)).select(
        "file", "block", F.substring(F.col("content"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("ids"))


def scan(blocks: DataFrame, width: int = 2, end_id: int = END_ID) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): a row per document of each file, ``n_tokens`` with the end id."""
    kind = f"<u{width}"

    @F.pandas_udf("struct<n:bigint,ends:array<bigint>>")
    def search(ids: pd.Series) -> pd.DataFrame:
        n, ends = [], []
        for b in ids:
            a = np.frombuffer(b, kind)
            n.append(len(a))
            ends.append(np.flatnonzero(a == end_id))
        return pd.DataFrame({"n": n, "ends": ends})

    prepared(blocks.sparkSession)
    found = blocks.select("file", "block", search("ids").alias("f")).select("file", "block", "f.*")
    found = written(found, "scan-blocks")
    behind = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    # prefix scan: ids before the block, documents ended before it, and where the last of them ended
    placed = (found.withColumn("at", F.coalesce(F.sum("n").over(behind), F.lit(0)))
              .withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(behind), F.lit(0)))
              .withColumn("until", F.col("at") + last_end + 1)
              .withColumn("open", F.coalesce(F.last("until", True).over(behind), F.lit(0)))
              .withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()))
    whole = placed.select("file", "at", "docs", "open", F.posexplode("ends").alias("i", "e"), "ends").select(
        "file", (F.col("docs") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1).alias("start"),
        (F.col("at") + F.col("e") + 1).alias("stop"), F.lit(True).alias("ended"))
    rest = placed.where("final").select(
        "file", (F.col("docs") + F.size("ends")).alias("ordinal"), F.coalesce("until", "open").alias("start"),
        (F.col("at") + F.col("n")).alias("stop"), F.lit(False).alias("ended")).where("stop > start")
    return whole.unionByName(rest).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def flatten(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, block_ids: int = BLOCK_IDS, end_id: int = SEPARATOR,
            id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as flat token files, one for each task's rows: (blocks (file, block, ids), manifest (file, ordinal, doc_id)).

    Ids are two bytes each (vocabularies below 65,536), ``end_id`` is none that a text gives.  Both come from one written table, so that they agree for good.
    """
    spark = prepared(docs.sparkSession)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("ordinal", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType)])

    def lay(batches):
        encoder = ChunkEncoder.of(tokenizer)
        held, block, ordinal = np.zeros(0, "<u2"), 0, 0

        def rows(blocks, ids, first):
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([*range(first, first + n), *[None] * m], pa.int64()), pa.array([*[b.tobytes() for b in blocks], *[None] * m], pa.binary()),
                pa.array([*[None] * n, *range(ordinal, ordinal + m)], pa.int64()),
                pa.concat_arrays([pa.nulls(n, ids.type), ids])], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi in text_groups(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(lo, hi - lo))
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("token ids don't fit into two bytes")
                if (ids == end_id).any():
                    raise ValueError(f"a text gives the id {end_id}, which ends documents")
                flat = np.concatenate([held, np.insert(ids.astype("<u2"), at[1:], end_id)])
                full = len(flat) // block_ids
                own = batch.column(0).slice(lo, hi - lo)
                yield rows([flat[k * block_ids:(k + 1) * block_ids] for k in range(full)], own, block)
                held, block, ordinal = flat[full * block_ids:], block + full, ordinal + len(own)
        if len(held):
            yield rows([held], pa.nulls(0, kind), block)

    laid = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lay, schema)
    table = written(laid.withColumn("file", F.spark_partition_id()), "token-files")
    return (table.where(F.col("block").isNotNull()).select("file", "block", "ids"),
            table.where(F.col("ordinal").isNotNull()).select("file", "ordinal", "doc_id"))


def document_token_counts(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens (with the end id) of every document, counted by scanning its flat file."""
    blocks, manifest = flatten(docs, tokenizer, block_ids)
    return manifest.join(scan(blocks, end_id=SEPARATOR), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")

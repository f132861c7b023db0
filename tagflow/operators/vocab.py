"""Vocabularies and encodings (V1-V8).

Dictionaries are DataFrames (key, id) with ids assigned in sorted key order
(any bijection is equivalent; sorted order makes them reproducible).  Lookups
are joins: the planner broadcasts a dictionary only when its measured size is
below the broadcast threshold (AQE), otherwise it shuffles and splits hot keys
(skew join); frequent words never end up in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.operators import coded as cd
from tagflow.operators.ids import dense_index
from tagflow.schema import labels_df
from tagflow.session import scratch

UNK_WORD, PAD_WORD = "<UNK>", "<PAD>"
UNK_FEATURE, PAD_FEATURE = "<UNK>", "<PAD>"


def build_dictionary(keys: DataFrame, key: str, id_col: str, reserved: dict[str, int], first_id: int) -> DataFrame:
    """Distinct keys -> (key, id) from ``first_id`` in sorted order, plus reserved rows.

    The keys are written once before the sort, which reads its input twice (for its bounds, then for the rows).
    """
    spark = keys.sparkSession
    path = scratch(spark, "keys")
    keys.select(key).where(F.col(key).isNotNull() & ~F.col(key).isin(list(reserved))).distinct().write.parquet(path)
    ids = dense_index(spark.read.parquet(path), [key], id_col, first_id).select(key, id_col)
    res = spark.createDataFrame(sorted(reserved.items(), key=lambda kv: kv[1]), f"{key} string, {id_col} bigint")
    return ids.unionByName(res)


def word_vocab(tokens: DataFrame, tok_col: str = "tok", fit_on: tuple[str, ...] = ("train", "dev"), split_col: str = "split") -> DataFrame:
    """V1: distinct words of the splits ``fit_on`` (all rows where there is no split column); <UNK>=0, <PAD>=1, others from 2."""
    if split_col in tokens.columns:
        tokens = tokens.where(F.col(split_col).isin(list(fit_on)))
    return build_dictionary(tokens.select(F.col(tok_col).alias("word")), "word", "word_id",
                            {UNK_WORD: 0, PAD_WORD: 1}, 2)


DICT_BROADCAST_GUARD = 256 << 20  # bytes of (key, id) rows that may be broadcast
HOT_KEYS_MAX = 100_000            # at most this many keys are treated as hot


def lookup(df: DataFrame, table: DataFrame, col: str, guard_bytes: int = DICT_BROADCAST_GUARD, hot_keys: int = HOT_KEYS_MAX) -> DataFrame:
    """Left join of ``df`` with a table of one row per value of ``col``, whatever the table's size and the keys' skew.

    * table measured under ``guard_bytes``: broadcast hash join (no shuffle of the large side at all);
    * otherwise: keys holding at least 1/``hot_keys`` of the rows (so at most ``hot_keys`` of them - a proven bound) are
      looked up through a broadcast of their rows, and only the rest is shuffled into a join.  Frequent keys never pile up in one task.
    """
    rest = [c for c in table.columns if c != col]
    if table_bytes(table) <= guard_bytes:
        return df.join(F.broadcast(table), col, "left")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    hot = counts.where(F.col("_c") * hot_keys >= total).select(col)
    found = hot.join(table, col, "left").select(col, F.struct(*rest).alias("_hot"))
    j = df.join(F.broadcast(found), col, "left")
    near = j.where(F.col("_hot").isNotNull()).select(*df.columns, *[F.col("_hot")[c].alias(c) for c in rest])
    far = j.where(F.col("_hot").isNull()).drop("_hot").join(table, col, "left").select(*df.columns, *rest)
    return near.unionByName(far)


def table_bytes(table: DataFrame) -> int:
    """Measured size of a lookup table: the bytes of its rows as text, and 16 per row (one small aggregate)."""
    r = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int((r["b"] or 0) + 16 * r["n"])


def encode(df: DataFrame, dictionary: DataFrame, col: str, key: str, id_col: str, unk_id: int,
           guard_bytes: int = DICT_BROADCAST_GUARD, hot_keys: int = HOT_KEYS_MAX) -> DataFrame:
    """V2/V5: dictionary lookup, unseen keys -> ``unk_id``."""
    d = dictionary.select(F.col(key).alias(col), F.col(id_col).alias("_id"))
    out = lookup(df, d, col, guard_bytes, hot_keys)
    return out.withColumn(id_col, F.coalesce(F.col("_id"), F.lit(unk_id)).cast("long")).drop("_id")


def word_encode(tokens: DataFrame, vocab: DataFrame, tok_col: str = "tok") -> DataFrame:
    """V2: word -> id, unknown words -> <UNK> (0)."""
    return encode(tokens, vocab, tok_col, "word", "word_id", 0)


def feature_set(feats_long: DataFrame, feature_col: str = "feature") -> DataFrame:
    """V3: distinct features (fit on the training split)."""
    return feats_long.select(feature_col).where(F.col(feature_col).isNotNull()).distinct()


def feature_dict(features: DataFrame, feature_col: str = "feature") -> DataFrame:
    """V4: feature -> id; <PAD>=0, <UNK>=1, others from 2 in sorted order."""
    return build_dictionary(features.select(F.col(feature_col).alias("feature")), "feature", "feature_id",
                            {PAD_FEATURE: 0, UNK_FEATURE: 1}, 2)


def feature_encode(feats_long: DataFrame, fdict: DataFrame, feature_col: str = "feature") -> DataFrame:
    """V5: feature -> id with unseen features -> <UNK> (1)."""
    return encode(feats_long, fdict, feature_col, "feature", "feature_id", 1)


def feature_encode_wide(wide: DataFrame, fdict: DataFrame, cols: list[str], keys: list[str], guard_bytes: int = DICT_BROADCAST_GUARD) -> DataFrame:
    """V5 on one column per feature slot: adds ``fids`` (array of ids in the order of ``cols``).

    A dictionary under the guard is broadcast once and looked up per column; beyond it the tokens go through ``encode_by_chunks``
    (``keys`` identify a token).
    """
    if table_bytes(fdict) <= guard_bytes:
        out = wide
        for c in cols:
            d = fdict.select(F.col("feature").alias(c), F.col("feature_id").alias(f"_id_{c}"))
            out = out.join(F.broadcast(d), c, "left")
        ids = F.array(*[F.coalesce(F.col(f"_id_{c}"), F.lit(1)).cast("long") for c in cols])
        return out.withColumn("fids", ids).select(*[c for c in wide.columns if c not in cols], "fids")
    return encode_by_chunks(wide, fdict, cols)


def feature_encode_coded(coded: cd.Coded, fdict: DataFrame) -> cd.Coded:
    """V5 on tokens coded by chunks: each chunk's list of distinct features meets the dictionary, unseen features -> <UNK> (1)."""
    return cd.named(coded, fdict, 1)


CHUNK_ROWS = 1 << 18  # tokens that share a list of their features


def coded_chunks(wide: DataFrame, cols: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Tokens in chunks of ``chunk_rows`` of a task's rows, features as numbers within the chunk; written once to the shared folder.

    Rows with ``_feature`` are the chunk's list (_chunk, _code, _feature), the others its tokens (_chunk, the other columns, _c0, _c1 ...).
    """
    spark, rest = wide.sparkSession, [c for c in wide.columns if c not in cols]
    kinds = [T.StructField("_chunk", T.LongType()), *[wide.schema[c] for c in rest], *[T.StructField(f"_c{k}", T.IntegerType()) for k in range(len(cols))],
             T.StructField("_code", T.IntegerType()), T.StructField("_feature", T.StringType())]
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])

    def coded(number, held):
        table = pa.Table.from_batches(held)
        own = pa.chunked_array([x for c in cols for x in table[c].chunks], pa.string()).combine_chunks().dictionary_encode()
        if isinstance(own, pa.ChunkedArray):
            own = own.combine_chunks()
        n, m, features = table.num_rows, len(own.dictionary), own.dictionary
        codes = [own.indices.slice(k * n, n).cast(pa.int32()) for k in range(len(cols))]
        yield from pa.table([pa.array(np.full(n, number)), *[table[c] for c in rest], *codes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=kinds.names).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), *[pa.nulls(m, table[c].type) for c in rest], *[pa.nulls(m, pa.int32()) for _ in cols],
                                          pa.array(np.arange(m, dtype=np.int32)), features], names=kinds.names)

    def run(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield from coded(number, held)
                number, held, rows = number + 1, [], 0
        if held:
            yield from coded(number, held)

    path = scratch(spark, "feature-chunks")
    wide.select(*rest, *cols).mapInArrow(run, kinds).write.parquet(path)
    return spark.read.parquet(path)


def encode_by_chunks(wide: DataFrame, fdict: DataFrame, cols: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``feature_encode_wide`` for a dictionary of any size: each chunk's list of distinct features meets the dictionary in one join and comes to the
    chunk's tokens, which are shuffled as numbers.  Features travel once for a chunk and not for each token and slot."""
    rest = [c for c in wide.columns if c not in cols]
    coded = coded_chunks(wide, cols, chunk_rows)
    asked = coded.where(F.col("_feature").isNotNull()).select(F.col("_chunk").alias("_to"), "_code", F.col("_feature").alias("feature"))
    ids = asked.join(fdict.select("feature", "feature_id"), "feature").select("_to", "_code", "feature_id")
    codes = [f"_c{k}" for k in range(len(cols))]
    tokens = coded.where(F.col("_feature").isNull()).select("_chunk", *rest, *codes)
    schema = T.StructType([*[T.StructField(c, wide.schema[c].dataType, True) for c in rest], T.StructField("fids", T.ArrayType(T.LongType()))])

    def named(left, right):
        code = right["_code"].to_numpy()
        table = np.ones((int(code.max()) if len(code) else -1) + 2, np.int64)  # the last entry: features outside the dictionary
        table[code] = right["feature_id"].to_numpy()
        at = np.column_stack([left[c].to_pandas().fillna(len(table) - 1).to_numpy(np.int64) for c in codes])
        flat = table[np.minimum(at, len(table) - 1)].ravel()
        fids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(codes), dtype=np.int32)), pa.array(flat))
        return pa.table([*[left[c] for c in rest], fids], names=[*rest, "fids"])

    out = tokens.groupBy("_chunk").cogroup(ids.groupBy("_to")).applyInArrow(named, schema)
    return out.select(*rest, "fids")


def label_encode(df: DataFrame, spark: SparkSession | None = None, tag_col: str = "tag",
                 pad_name: str = "<PAD>") -> DataFrame:
    """V6: tag string -> id; an unknown tag fails the job (strict, like a dict lookup)."""
    spark = spark or df.sparkSession
    lab = F.broadcast(labels_df(spark, pad_name).withColumnRenamed("label", tag_col))  # 30 rows
    j = df.join(lab, tag_col, "left")
    checked = F.when(F.col("label_id").isNull(),
                     F.raise_error(F.concat(F.lit("unknown label: "), F.col(tag_col)))).otherwise(F.col("label_id"))
    return j.withColumn("label_id", checked.cast("int"))


def tag_decode(df: DataFrame, spark: SparkSession | None = None, id_col: str = "tag_id",
               pad_name: str = "<PAD>") -> DataFrame:
    """Id -> tag string; rows with ids outside the dictionary are dropped."""
    spark = spark or df.sparkSession
    lab = F.broadcast(labels_df(spark, pad_name).withColumnRenamed("label_id", id_col))  # 30 rows
    return df.join(lab, id_col, "inner").withColumnRenamed("label", "tag")


def corpus_stats(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", tag_id: str | None = "tag_id") -> DataFrame:
    """V8: number of sequences, tokens, longest sequence, distinct labels (one row)."""
    # the labels of a sequence as bits (a dictionary of at most 64 labels)
    labels = [F.expr(f"bit_or(shiftleft(1L, {tag_id}))").alias("_l")] if tag_id is not None else []
    lens = tokens.groupBy(key).agg((F.max(pos) + 1).alias("n"), *labels)
    stats = [F.count(F.lit(1)).alias("n_seqs"), F.sum("n").cast("long").alias("n_tokens"), F.max("n").cast("int").alias("max_len")]
    if tag_id is not None:
        stats.append(F.bit_count(F.bit_or("_l")).cast("int").alias("n_labels"))
    return lens.agg(*stats)

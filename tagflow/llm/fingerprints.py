"""Document fingerprints by locally consistent parsing.

A text is a string of symbols (code points at first).  On each level runs of one symbol become one block; in the rest,
deterministic coin tossing (the lowest bit in which a symbol differs from its left neighbour, with that bit's place,
applied until six labels are left) makes labels of which no two neighbours are equal; a symbol whose label is a local
maximum begins a phrase, which therefore has about ten symbols at most.  A phrase's name is a hash of its symbols; the names
are the next level's string.  Where a phrase ends depends on a few symbols around it, so equal substrings get equal
names inside, at whatever offset they stand.  The fingerprint is a one-permutation min-hash (``SLOTS`` slots of 16 bits)
over the distinct names from level ``FIRST_LEVEL`` up (of about 15 code points); two fingerprints' likeness is the share
of equal slots among those that either fills, an estimate of the Jaccard likeness of the texts' phrase sets.

Defined cases: a null text counts as empty, and an empty text has the fingerprint without any slot (likeness 1 to
another empty one, 0 to all else); short texts that never reach the level use the highest level they have; rows with equal ids are
ordered by text; null ids come first; repeated rows are rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.llm.common import prepared, written

SLOTS, FIRST_LEVEL, LEVELS = 64, 3, 40
CHUNK = 250_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EMPTY = np.uint16(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of names."""
    x = (x ^ (x >> np.uint64(31))) * _B
    x ^= x >> np.uint64(29)
    return x * _A


def _tossing(bits: int) -> np.ndarray:
    """Table over (left, own) labels of ``bits`` bits: twice the place of the lowest bit that differs, plus that bit of own."""
    own = np.arange(1 << bits, dtype=np.int64)
    diff = own[:, None] ^ own[None, :]
    place = np.bitwise_count((diff & -diff) - 1).astype(np.int64)
    place[diff == 0] = 0
    return (2 * place + (own[None, :] >> place & 1)).astype(np.uint8).reshape(-1)


#: 128 labels come down to 14, to 8 and to 6.
_TABLES = [(bits, _tossing(bits)) for bits in (7, 4, 3)]


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unequal between neighbours; ``first`` are the places of the texts' first symbols, which see no neighbour."""
    one = x.dtype.type(1)
    diff = x[1:] ^ x[:-1]
    low = np.zeros(len(x), np.uint8)
    np.bitwise_count((diff & (~diff + one)) - one, out=low[1:])
    label = (low << 1) | ((x >> low) & one).astype(np.uint8)
    label[first] = (x[first] & one).astype(np.uint8)
    for bits, table in _TABLES:
        pair = np.zeros(len(label), np.uint16)
        pair[1:] = label[:-1].astype(np.uint16) << bits
        new = table.take(pair | label)
        new[first] = label[first] & 1
        label = new
    return label


def parse(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, text of each) of the phrases of the symbols ``x`` in texts numbered ``doc`` (sorted)."""
    head = np.ones(len(x), bool)
    head[1:] = x[1:] != x[:-1]
    head[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(head)
    x, doc = x[at], doc[at]
    length = np.diff(np.append(at, len(head)))
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    label = _labels(x, first)
    begin = np.zeros(len(x), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    begin[first] = True
    b = np.flatnonzero(begin)
    size = np.diff(np.append(b, len(x)))
    place = np.arange(len(x), dtype=np.int32) - np.repeat(b.astype(np.int32), size)
    # a polynomial of the symbols (with the lengths of their runs) by their place in the phrase
    power = np.cumprod(np.full(int(size.max()), _A, np.uint64))
    terms = _mixed(x.astype(np.uint64) + (length - 1).astype(np.uint64) * _B) * power.take(place)
    return _mixed(np.add.reduceat(terms, b) + size.astype(np.uint64)), doc[b]


def sketches(texts: list[str]) -> np.ndarray:
    """uint16 array (texts, SLOTS); 0 marks a slot that no name falls into."""
    out = np.full((len(texts), SLOTS), 0xFFFFFFFF, np.uint32)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for level in range(LEVELS):
        if not len(x):
            break
        done = np.bincount(doc, minlength=len(texts))[doc] == 1  # texts that have come down to one name end here
        ends = done.any()
        if level >= FIRST_LEVEL or ends:
            use = slice(None) if level >= FIRST_LEVEL else done
            h = _mixed(x[use].astype(np.uint64) + _A)
            at = doc[use].astype(np.int64) * SLOTS + (h >> np.uint64(58)).astype(np.int64)
            np.minimum.at(out.reshape(-1), at, (h >> np.uint64(16)).astype(np.uint32))
        if ends:
            x, doc = x[~done], doc[~done]
        if len(x):
            x, doc = parse(x, doc)
    filled = out != 0xFFFFFFFF
    low = (out & 0xFFFF).astype(np.uint16)
    low[low == 0] = 1
    return np.where(filled, low, _EMPTY)


def fingerprint(sketch: np.ndarray) -> str:
    """4 hex digits for each slot, most significant digit first; an empty slot is 0000."""
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise share of equal slots among those filled in either; 1 where neither has any."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, equal / np.maximum(either, 1))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of ``text`` replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def overlapped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_part, _next, doc_id, text): the documents cut into id ranges, each with the first document of the next as its last row.

    Cut points come from approximate quantiles of the ids (one number for each range); results don't depend on them.
    The first document of all follows the last one.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    edges = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # binary search over the cut points is a filter here: the array is as short as the number of ranges
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))))
    ids = ids.withColumn("_part", part)
    heads = {r["_part"]: r["d"] for r in ids.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("d")).collect()}
    if not heads:
        return ids.select("_part", F.lit(False).alias("_next"), "doc_id", "text")
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's head goes behind the last range
    firsts = written(ids.where(F.col("doc_id").isNull() if heads[order[0]]["doc_id"] is None else F.lit(False)).select("_part", "doc_id", "text")
                     .unionByName(ids.where(F.col("doc_id").isin([h["doc_id"] for h in heads.values() if h["doc_id"] is not None])).select("_part", "doc_id", "text"))
                     .groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text")).alias("h")), "lcp-heads")
    to = F.create_map(*[F.lit(x) for p in order for x in (p, before[p])])
    moved = firsts.select(to[F.col("_part")].alias("_part"), F.lit(True).alias("_next"), "h.doc_id", "h.text")
    both = ids.select("_part", F.lit(False).alias("_next"), "doc_id", "text").unionByName(moved)
    return both.repartition(n, "_part").sortWithinPartitions("_part", "_next", F.col("doc_id").isNotNull(), "doc_id", "text")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                       T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
                       T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every document: one pass, no shuffle."""
    prepared(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(s) for part in _chunks(texts.fillna("").tolist()) for s in sketches(part)], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col).cast("string")).alias("fingerprint"))


def _chunks(texts: list[str]):
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likeness to that and to the next document."""
    prepared(docs.sparkSession)

    def compare(batches):
        held = None  # (part, doc_id, text, next?) of the last row seen
        for b in batches:
            rows = list(zip(b["_part"].tolist(), [None if pd.isna(i) else int(i) for i in b["doc_id"]], b["text"].tolist(), b["_next"].tolist()))
            if held is not None:
                rows.insert(0, held)
            if rows:
                held = rows[-1]
            lo, size = 0, 0
            for i in range(len(rows)):  # pieces of rows, each with the row behind it
                size += len(rows[i][2])
                if i + 1 == len(rows) or size > CHUNK:
                    if out := compared(rows[lo:i + 1]):
                        yield pd.DataFrame(out, columns=SCHEMA.names).astype({"doc_id": "Int64"})
                    lo, size = i, len(rows[i][2])

    def compared(rows):
        if len(rows) < 2:
            return []
        plain = sketches([r[2] for r in rows])
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][3]]
        new = [edited(rows[i][2], rows[i + 1][2]) for i in pairs]
        other = sketches(new) if new else np.zeros((0, SLOTS), np.uint16)
        near_e, near_n = likeness(plain[pairs], other), likeness(plain[pairs], plain[[i + 1 for i in pairs]])
        return [(rows[i][1], len(rows[i][2]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(plain[i]), fingerprint(other[k]),
                 float(near_e[k]), float(near_n[k])) for k, (i, t) in enumerate(zip(pairs, new))]

    return overlapped(docs, id_col, text_col).mapInPandas(compare, SCHEMA)

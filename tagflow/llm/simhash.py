"""SimHash near-duplicates with pivot distance tables.

*Fingerprints.*  Words of the lower-cased (A-Z) text in ``shingle``-word shingles, repeats included, hashed by XXH64 (seed 42);
a bit is 1 if set in over half of the hashes.
*Candidates.*  Distinct fingerprints only (copies are a membership table).  The 64 bits are cut into ``2 * max_bits`` blocks; two
fingerprints within ``max_bits`` bits agree in at least half of the blocks, so they meet under one of the masks over half of the
blocks (20 masks of about 32 bits for 3 bits): no pair is lost, and few others meet.
*Pivots.*  Each fingerprint has a row of Hamming distances to many fixed reference fingerprints.  Distances to a pivot differ by no more
than the pair's own distance, so a pair whose rows differ by more than ``max_bits`` in any coordinate is discarded; the survivors
are verified by their own distance.
*Groups.*  What meets under a mask is worked on in units of ``UNIT`` rows; a larger group is dealt into parts, and every pair of parts is
a unit.  A unit returns a spanning forest of its links, at most one link for each row, never all pairs.
*Components.*  Links are contracted by alternating large-star and small-star steps on tables in the shared checkpoint folder.

Defined cases: null and empty texts (and those without words) have fingerprint zero and are linked like any other; with fewer words than a
shingle the whole sequence is hashed; null ids are rows of their component (its id is the smallest id that isn't null, or null);
repeated rows are rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import dropped, prepared, written

SHINGLE, MAX_BITS, SEED, UNIT, PIVOTS = 3, 3, 42, 4096, 24


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text."""
    from xxhash import xxh64_digest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[:n].tolist()
    stops = (ends[-1:] if n == 1 else ends[shingle - 1:]) - 1
    ones, at = np.zeros(64, np.int64), list(zip(starts, stops.tolist()))
    for lo in range(0, n, 1 << 16):
        h = np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in at[lo:lo + (1 << 16)]]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text hash ``h`` and signed fingerprint ``fp`` of every document; no shuffle."""
    prepared(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), of(text).alias("fp"))


def masks(max_bits: int) -> list[int]:
    """64-bit masks over half of ``2 * max_bits`` blocks (all bits for 0)."""
    if not max_bits:
        return [(1 << 64) - 1]
    edges = [round(64 * i / (2 * max_bits)) for i in range(2 * max_bits + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, max_bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first bytes of the md5 of their numbers."""
    return np.array([int.from_bytes(hashlib.md5(f"pivot {i}".encode()).digest()[:8], "big") for i in range(n)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows linked by (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def unit_links(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that span the components within each unit; rows are sorted by unit.

    ``side`` is 0 in units of one part; in a unit of two parts it is 1 or 2 and only pairs across are looked at.
    """
    x = fp.view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ pivots()[None, :]).astype(np.int8)
    end = np.searchsorted(unit, unit, side="right")
    left, right, found, step = [], [], 0, 1
    rows = np.flatnonzero(np.arange(len(x)) + 1 < end)
    while len(rows):
        for lo in range(0, len(rows), 1 << 18):
            own = rows[lo:lo + (1 << 18)]
            own = own[(side[own] == 0) | (side[own] != side[own + step])]
            for c in range(0, table.shape[1], 4):  # few pivots decide most pairs
                far = np.abs(table[own, c:c + 4] - table[own + step, c:c + 4]).max(axis=1) > max_bits if len(own) else np.zeros(0, bool)
                own = own[~far]
            own = own[np.bitwise_count(x[own] ^ x[own + step]) <= max_bits]
            left.append(own)
            right.append(own + step)
            found += len(own)
        if found > 1 << 21:  # contract what has been found so far
            root = _forest(len(x), np.concatenate(left), np.concatenate(right))
            left, right = [np.flatnonzero(root != np.arange(len(x)))], [root[root != np.arange(len(x))]]
            found = 0
        step += 1
        rows = rows[rows + step < end[rows]]
    a, b = (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))
    root = _forest(len(x), a, b)
    at = np.flatnonzero(root != np.arange(len(x)))
    return fp[at], fp[root[at]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) fingerprints that span the components of "at most ``max_bits`` bits apart" under each mask.  ``distinct`` has ``fp``, each once."""
    prepared(distinct.sparkSession)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(max_bits)])).alias("m", "k"))
    sizes = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meet = keyed.join(sizes, ["m", "k"])
    parts = F.ceil(F.col("n") / UNIT).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    units = (meet.select("m", "k", "fp", part.alias("p"), parts.alias("ps"))
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
             .select("m", "k", "fp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"),
                     F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).alias("side")))
    dealt = units.repartition("m", "k", "i", "j").sortWithinPartitions("m", "k", "i", "j", "fp")

    def work(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b])
            t = t.combine_chunks()
            names = [np.asarray(t.column(c)) for c in ("m", "k", "i", "j")]
            new = np.zeros(t.num_rows, bool)
            for c in names:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            last = int(starts[-1]) if len(starts) else 0  # the last unit may go on in the next batch
            if last:
                yield made(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()[0] if t.num_rows > last else None
        if held is not None and held.num_rows:
            yield made(pa.Table.from_batches([held]))

    def made(t):
        fp, side = np.asarray(t.column("fp")), np.asarray(t.column("side"))
        new = np.zeros(t.num_rows, np.int64)
        for c in ("m", "k", "i", "j"):
            v = np.asarray(t.column(c))
            new[1:] |= v[1:] != v[:-1]
        u, v = unit_links(fp, np.cumsum(new), side, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(work, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has a link.  Stars alternate until nothing moves."""
    def checked(df, name):
        t = written(df, name)
        r = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return t, tuple(r)

    now, state = checked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))).where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after, new = checked(small, "links")
        dropped(now)
        if new == state:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, state = after, new


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text hash ``h``, signed fingerprint ``fp``, component_id (smallest id reachable over links)
    and ``first``, whether id and hash are the smallest of the component (null ids last)."""
    table = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = written(table.groupBy("fp").agg(F.min(own).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    member = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "least", "root")  # only fingerprints with a link
    linked = written(member.select("fp", "root").join(member.groupBy("root").agg(F.min("least").alias("lowest")), "root")
                     .select("fp", "lowest"), "simhash-components")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("least"))
    return table.join(of, "fp").select("doc_id", "h", "fp", F.col("least.doc_id").alias("component_id"), (own == F.col("least")).alias("first"))


def hexed(fp: Column) -> Column:
    """16 lowercase hex digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document (all columns) of each component: that with the smallest id, then text hash; of equal rows one.

    One shuffle of the texts: the choice of one row runs in the join's partitions.
    """
    key = lambda i, h: F.concat_ws(":", h.cast("string"), i.cast("string"))
    stays = (near_duplicates(docs, shingle, max_bits, id_col, text_col).where("first")
             .select(key(F.col("doc_id"), F.col("h")).alias("_key")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("_key"))
    one = Window.partitionBy("_key").orderBy(F.lit(1))
    return (row.join(stays, "_key", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*"))

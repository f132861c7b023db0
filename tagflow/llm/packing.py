"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` (only longer documents are cut).  What remains to be
packed is described fully by the histogram of piece lengths, at most ``capacity`` numbers whatever the corpus
size.  On it a plan is made: per bin the longest remaining length is placed, a bitset subset-sum over the
remaining lengths (a Python integer whose bit f says that fill f is reachable) finds the fullest feasible
combination, and the combination is removed as often as the counts allow.  Each combination uses up
one length at least, so the plan has at most ``capacity`` of them.  Spark then ranks the pieces within
their length and each piece reads its sequence and offset from the plan; no group of equal lengths meets in one task.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; null ids are packed;
an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.llm.common import cumulated, dropped, prepared, written
from tagflow.llm.tokens import DEFAULT_TOKENIZER, ChunkEncoder, text_groups

CAPACITY, END_ID = 4096, 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, the piece's token ids."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches):
        encoder = ChunkEncoder.of(tokenizer)
        for batch in batches:
            for lo, hi in text_groups(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(lo, hi - lo))
                doc, piece, start, length, crc, own = [], [], [], [], [], []
                for i in range(hi - lo):
                    seq = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, b in enumerate(range(0, len(seq), capacity)):
                        part = seq[b:b + capacity]
                        doc.append(lo + i), piece.append(k), start.append(b), length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(own, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    prepared(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, within ``counts``) whose sum is the largest one not above ``room``."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        step = 1
        while left and not reach >> room & 1:  # copies in binary portions: 1, 2, 4, ... and the rest
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, []
    for length, take, before in reversed(layers):
        if not before >> at & 1:  # not reachable without this portion
            found += [length] * take
            at -= length * take
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, number of bins)] by minimum bin slack; empties the histogram."""
    left, made = {x: n for x, n in histogram.items() if n}, []
    while left:
        first = max(left)
        rest = {x: n - (x == first) for x, n in left.items() if n > (x == first)}
        bin_ = [first, *fullest(rest, capacity - first)]
        uses = Counter(bin_)
        times = min(left[x] // k for x, k in uses.items())
        for x, k in uses.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        made.append((bin_, times))
    return made


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with ``length`` from 1 to ``capacity`` and any other columns) plus sequence_id and offset."""
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]
    table = written(cut, "pack-pieces")
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    segments: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    given, bins = Counter(), 0
    for bin_, times in plan(histogram, capacity):
        at: dict[int, list[int]] = {}
        for off, x in zip(np.cumsum([0, *bin_]), bin_):
            at.setdefault(x, []).append(int(off))
        for x, offs in at.items():
            segments.setdefault(x, []).append((given[x], bins, len(offs), offs))
            given[x] += len(offs) * times
        bins += times
    known = table.sparkSession.sparkContext.broadcast(segments)  # bounded by the capacity, not by the corpus
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names = table.columns

    def place(batches):
        starts = {x: np.array([s[0] for s in segs]) for x, segs in known.value.items()}
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(starts[x], rank[rows], side="right") - 1
                for s in np.unique(k):
                    base, first, m, offs = known.value[x][s]
                    own = rows[k == s]
                    q = rank[own] - base
                    seq[own], off[own] = first + q // m, np.array(offs)[q % m]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    light = cumulated(table, ["length"], order, None, "pack-ranks")
    dropped(table)
    return light.drop("_count").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from packed pieces that carry ``ids`` (a sequence has at most capacity tokens)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))

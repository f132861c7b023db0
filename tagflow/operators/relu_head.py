"""Dense - ReLU - dense - softmax over frozen vectors, trained by mini-batch SGD.

Weights are two small dense layers (d x h and h x k numbers, bounded by the arguments), held by the driver and sent with each step.  A step is one job:
tasks run forward and backward over their rows of the batch in numpy and add gradients up; a whole table's sums (``gradient``) are added by Spark by weight row.
Rows get their batch from the seeded hash of their id, once, and keep it for all epochs, each batch in partitions of its own; the result doesn't depend on partitions
but for the order of floating-point sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.operators.metrics import argmax
from tagflow.session import kept_rdd


@dataclass
class ReluHead:
    w1: np.ndarray  # (d, h)
    b1: np.ndarray
    w2: np.ndarray  # (h, k)
    b2: np.ndarray

    @classmethod
    def start(cls, d: int, h: int, k: int) -> "ReluHead":
        """Spread-out starting weights by a rule that other engines can follow: whole numbers modulo primes, scaled by the fan-in."""
        i, j = np.arange(d)[:, None], np.arange(h)[None, :]
        c = np.arange(k)[None, :]
        return cls(((i * 37 + j * 101) % 199 - 99) / 99 * np.sqrt(2 / d), np.zeros(h), ((j.T * 53 + c * 29) % 197 - 98) / 98 * np.sqrt(2 / h), np.zeros(k))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0.0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, "ReluHead"]:
        """(sum of -log p of the labels, its gradient) over rows."""
        hidden, p = self.hidden(x), self.probabilities(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
        p[np.arange(len(y)), y] -= 1.0
        back = (p @ self.w2.T) * (hidden > 0)
        return float(loss), ReluHead(x.T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0))

    def moved(self, g: "ReluHead", by: float) -> "ReluHead":
        return ReluHead(self.w1 - by * g.w1, self.b1 - by * g.b1, self.w2 - by * g.w2, self.b2 - by * g.b2)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def gradient(rows: DataFrame, head: ReluHead, vec_col: str = "embedding", label_col: str = "label") -> tuple[float, int, ReluHead]:
    """(sum of losses, rows, summed gradient) of one batch: one job, a row of sums for each row of the weight matrices."""
    d, h = head.w1.shape
    k, wide = head.w2.shape[1], max(head.w1.shape[1], head.w2.shape[1])

    def run(batches):
        loss, n, total = 0.0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            got, g = head.gradients(_vectors(b.column(0)), np.asarray(b.column(1), dtype=np.int64))
            loss, n = loss + got, n + b.num_rows
            total = g if total is None else total.moved(g, -1.0)
        if total is None:
            return
        out = np.zeros((d + h + 3, wide))
        out[:d, :h], out[d:d + h, :k], out[d + h, :h], out[d + h + 1, :k], out[d + h + 2, :2] = total.w1, total.w2, total.b1, total.b2, (loss, n)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + h + 3), pa.int64()), *[pa.array(np.ascontiguousarray(out[:, c])) for c in range(wide)]],
                                         names=["row", *[f"s{c}" for c in range(wide)]])

    cols = [f"s{c}" for c in range(wide)]
    sums = rows.select(F.col(vec_col).cast("array<double>"), F.col(label_col).cast("long")).mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in cols))
    got = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # d + h + 3 rows
    out = np.zeros((d + h + 3, wide))
    if got.num_rows:
        out[got["row"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in cols])
    return float(out[d + h + 2, 0]), int(out[d + h + 2, 1]), ReluHead(out[:d, :h], out[d + h, :h], out[d:d + h, :k], out[d + h + 1, :k])


def fit(train: DataFrame, n_classes: int, hidden: int = 128, epochs: int = 20, lr: float = 0.1, batch_size: int = 256, seed: int = 0, id_col: str = "vec_id",
        vec_col: str = "embedding", label_col: str = "label") -> tuple[ReluHead, list[float]]:
    """(head, mean loss of each epoch)."""
    spark = train.sparkSession
    own = train.select(id_col, vec_col, label_col).where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull())
    n, d = own.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    parts = max(1, -(-n // batch_size))
    head, history = ReluHead.start(d or 1, hidden, n_classes), []
    if not n:
        return head, [0.0] * epochs
    tasks = min(MOST_TASKS, -(-min(batch_size, n) // TASK_ROWS))
    rows = keep_batches(own.toDF("_id", "_v", "_y").withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(parts))), parts, tasks)
    for _ in range(epochs):
        total = 0.0
        for b in range(parts):
            loss, size, g = batch_gradient(rows, head, range(b * tasks, (b + 1) * tasks))
            total += loss
            if size:
                head = head.moved(g, lr / size)
        history.append(total / n)
    return head, history


TASK_ROWS, MOST_TASKS = 1 << 14, 64  # a batch of more rows is spread over tasks, at most so many


def keep_batches(rows: DataFrame, parts: int, tasks: int):
    """Rows (_id, _v, _y, _b) as an RDD of packed (vectors, labels), batch ``b`` in the partitions from ``b * tasks`` on, kept in the checkpoint folder:
    a step then runs on the partitions of its batch, without a plan or a listing of files."""
    placed = rows.withColumn("_p", (F.col("_b") * tasks + F.pmod(F.hash("_id"), F.lit(tasks))).cast("int"))
    placed = placed.select("_p", "_id", F.col("_v").cast("array<double>").alias("_v"), F.col("_y").cast("long").alias("_y"))

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_vectors(b.column(0)).tobytes()]), pa.array([np.asarray(b.column(1), np.int64).tobytes()])], names=["x", "y"])

    packed = placed.repartitionById(parts * tasks, "_p").sortWithinPartitions("_id").select("_v", "_y").mapInArrow(pack, "x binary, y binary")
    return kept_rdd(rows.sparkSession, packed.rdd.map(lambda r: (bytes(r.x), bytes(r.y))))


def batch_gradient(rows, head: ReluHead, partitions) -> tuple[float, int, ReluHead | None]:
    """``gradient`` of the rows in some partitions of ``keep_batches``: each task adds its rows up, the driver the tasks' sums (at most ``MOST_TASKS``)."""
    def run(chunks):
        loss, n, total = 0.0, 0, None
        for x, y in chunks:
            y = np.frombuffer(y, np.int64)
            got, g = head.gradients(np.frombuffer(x).reshape(len(y), -1), y)
            loss, n = loss + got, n + len(y)
            total = g if total is None else total.moved(g, -1.0)
        return [] if total is None else [(loss, n, total)]

    loss, n, total = 0.0, 0, None
    for own, size, g in rows.context.runJob(rows, run, list(partitions)):
        loss, n = loss + own, n + size
        total = g if total is None else total.moved(g, -1.0)
    return loss, n, total


def score(rows: DataFrame, head: ReluHead, vec_col: str = "embedding") -> DataFrame:
    """Adds ``probs`` and ``pred``; a row without a vector has neither."""
    @F.pandas_udf("array<double>")
    def probs(v):
        import pandas as pd
        return pd.Series(list(head.probabilities(np.stack([np.asarray(x, float) for x in v])))) if len(v) else pd.Series([], dtype=object)

    known = rows.where(F.col(vec_col).isNotNull()).withColumn("probs", probs(F.col(vec_col).cast("array<double>"))).withColumn("pred", argmax("probs"))
    none = rows.where(F.col(vec_col).isNull()).withColumn("probs", F.lit(None).cast("array<double>")).withColumn("pred", F.lit(None).cast("int"))
    return known.unionByName(none)

"""Hard negatives of anchor vectors through an inverted multi-index.

Two codebooks, one for each half of the components, are fitted on a bounded sample of ``SAMPLE`` rows.  Every row is indexed: its cell is the
pair of nearest codewords.  Rows sorted by label and cell are packed into blocks of at most ``ROWS`` rows, each a small inverted multi-index with
its cells' row lists and, for each codeword of either half, the radius its own rows need.  An anchor's score against a row of a cell is at
most the sum of two half bounds, (anchor half) . (codeword) + |anchor half| * radius; a multi-sequence heap visits a block's cells by
falling bound, and stops where no cell left can change the answer: the first ``positives`` rows of the label, or the first
``negatives`` rows in the window of each positive.  So answers are exact, whatever the codebooks are worth.

Anchors are a stated query set.  They meet the blocks in packs of at most ``ANCHORS`` (positives: only blocks that hold their label); a
task keeps the best rows of each anchor over all blocks it sees, so what is shuffled grows with anchors and tasks, never with pairs.

Vectors become whole numbers, floor(scale * x).  Scores are exact: 64-bit floats where no sum can reach 2^53, else 64-bit integers;
a score beyond 2^63 fails the job.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; components that the
shorter of several vectors lack are 0; rows without an id are no anchors, come last among ties and are returned with a null id; rows of an anchor's own id are not "other rows";
an id given in several rows counts row by row; fewer rows than asked for are all returned; an empty vector scores 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import prepared, written

SCALE, CODEWORDS, SAMPLE, LLOYD, ROWS, ANCHORS, CHUNK = 256, 16, 8192, 8, 8192, 1024, 1024
#: Window of a positive score p: LOW * p <= 100 * score <= 100 * p.
LOW = 80
#: Keys a task keeps before it hands on what it has found for them.
KEPT = 20_000


def whole_numbers(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part; v are whole numbers kept as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def padded(items: DataFrame) -> DataFrame:
    """The rows with vectors of one length."""
    most = items.agg(F.max(F.size("v"))).first()[0] or 0
    return items.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, components) of vectors of one length."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def codebooks(items: DataFrame, codewords: int = CODEWORDS, sample: int = SAMPLE) -> list[np.ndarray]:
    """Two codebooks by Lloyd's rounds on the ``sample`` rows with the least hash (collected: ``sample`` vectors at most)."""
    drawn = items.orderBy(F.xxhash64("id", "v"), "id", "v").limit(sample).select("v").toArrow()["v"].combine_chunks()
    x = matrix(drawn)
    half = x.shape[1] // 2
    books = []
    for part in (x[:, :half], x[:, half:]):
        distinct = np.unique(part, axis=0)
        book = distinct[np.linspace(0, len(distinct) - 1, min(codewords, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, part.shape[1]))
        for _ in range(LLOYD if len(part) else 0):
            near = nearest(part, book)
            for c in range(len(book)):
                if (near == c).any():
                    book[c] = part[near == c].mean(0)
        books.append(book)
    return books


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)


def assigned(items: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds the cell (c0, c1) of each row."""
    half = books[0].shape[1]

    def cells(batches):
        for b in batches:
            x = matrix(b.column(2))
            near = [nearest(p, k) if len(x) else np.zeros(0, int) for p, k in zip((x[:, :half], x[:, half:]), books)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c.astype(np.int32)) for c in near]], names=["id", "label", "v", "c0", "c1"])

    prepared(items.sparkSession)
    return items.mapInArrow(cells, "id long, label long, v array<double>, c0 int, c1 int")


def blocks(cells: DataFrame, rows: int = ROWS) -> DataFrame:
    """Packs rows in the order of label and cell: (block, n, labels, ids, known, label, c0, c1, v), arrays as bytes, at most ``rows`` rows in each."""
    schema = "block long, n int, labels array<long>, ids binary, known binary, label binary, c0 binary, c1 binary, v binary"

    def packed(batches):
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush(held, number):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, label = t["id"].combine_chunks() if t.num_rows else t["id"], np.asarray(t["label"])
            known = np.asarray(ids.is_valid())
            x = matrix(t["v"].combine_chunks())
            as_bytes = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
            one = [number, t.num_rows, np.unique(label).tolist(), as_bytes(np.asarray(ids.fill_null(0)), np.int64), as_bytes(known, np.bool_),
                   as_bytes(label, np.int64), as_bytes(t["c0"], np.int32), as_bytes(t["c1"], np.int32), as_bytes(x, np.float64)]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)],
                                              names=["block", "n", "labels", "ids", "known", "label", "c0", "c1", "v"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, rows - size)
                b = b.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == rows:
                    yield flush(held, number)
                    number, held, size = number + 1, [], 0
        if size:
            yield flush(held, number)

    prepared(cells.sparkSession)
    return cells.orderBy("label", "c0", "c1", "id").mapInArrow(packed, schema)


class Block:
    """One block as an inverted multi-index."""

    def __init__(self, row: dict, books: list[np.ndarray]):
        self.n = row["n"]
        self.id, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.bool_)
        self.label = np.frombuffer(row["label"], np.int64)
        code = [np.frombuffer(row[c], np.int32) for c in ("c0", "c1")]
        v = np.frombuffer(row["v"], np.float64).reshape(self.n, -1)
        order = np.lexsort((code[1], code[0]))  # a cell's rows side by side
        self.id, self.known, self.label, self.v = self.id[order], self.known[order], self.label[order], v[order]
        code = [c[order] for c in code]
        self.half = books[0].shape[1]
        self.words, self.centre, self.radius, place = [], [], [], []
        for c, x, book in zip(code, (self.v[:, :self.half], self.v[:, self.half:]), books):
            words, at = np.unique(c, return_inverse=True)
            gap = np.zeros(len(words))
            np.maximum.at(gap, at, np.sqrt(((x - book[c]) ** 2).sum(1)))
            self.centre.append(book[words]), self.radius.append(gap), place.append(at)
        cell = place[0] * len(self.radius[1]) + place[1]
        self.start = np.searchsorted(cell, np.arange(len(self.radius[0]) * len(self.radius[1]) + 1))
        self.reach = float(np.abs(self.v).max(initial=0.0))

    def half_bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: (codewords by falling bound, their bounds) for each anchor, a little above the exact bound."""
        out = []
        for x, centre, radius in zip((q[:, :self.half], q[:, self.half:]), self.centre, self.radius):
            size = np.sqrt((x * x).sum(1))[:, None]
            bound = x @ centre.T + size * radius
            bound += 1e-9 * (size * (np.sqrt((centre * centre).sum(1)) + radius)) + 1e-6
            order = np.argsort(-bound, axis=1, kind="stable")
            out.append((order, np.take_along_axis(bound, order, axis=1)))
        return out

    def visits(self, order: list[np.ndarray], bound: list[np.ndarray]):
        """(bound, rows of the cell) by falling bound: the multi-sequence heap over the two sorted half lists."""
        wide = len(self.radius[1])
        heap, first, second = [(-(bound[0][0] + bound[1][0]), 0, 0)], bound[0].tolist(), bound[1].tolist()
        while heap:
            minus, i, j = heapq.heappop(heap)
            cell = order[0][i] * wide + order[1][j]
            yield -minus, self.start[cell], self.start[cell + 1]
            # each pair is entered once: along the second list from any pair, along the first from pairs that lead theirs
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))

    def chunks(self, order, bound, least: int = CHUNK):
        """(bound of all that follows or None at the end, row numbers): visited cells gathered to ``least`` rows."""
        lots, n = [], 0
        for top, lo, hi in self.visits(order, bound):
            if n >= least:
                yield top, np.concatenate(lots)
                lots, n = [], 0
            if hi > lo:
                lots.append(np.arange(lo, hi))
                n += hi - lo
        yield None, np.concatenate(lots) if lots else np.zeros(0, int)

    def scores(self, q: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.v[rows] @ q).astype(np.int64)
        return self.v[rows].astype(np.int64) @ q.astype(np.int64)


def fits(block: Block, q: np.ndarray) -> bool:
    """Whether 64-bit floats hold all sums exactly."""
    largest = float(np.abs(q).max(initial=0.0)) * block.reach * max(block.v.shape[1], 1)
    if largest >= 2.0 ** 63:
        raise ValueError("a score may not fit 64 bits")
    return largest < 2.0 ** 53


class Best:
    """The first ``k`` rows found for a key: highest score, then smallest id, unknown ids last."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, score: np.ndarray, ident: np.ndarray, known: np.ndarray) -> None:
        if len(score) > self.k:
            order = np.lexsort((ident, ~known, -score))[:self.k]
            score, ident, known = score[order], ident[order], known[order]
        self.rows = sorted(self.rows + list(zip((-score).tolist(), (~known).tolist(), ident.tolist())))[:self.k]

    def floor(self) -> float:
        """Rows below this score can't enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else float("-inf")


def find_positives(block: Block, q: np.ndarray, ident: int, label: int, bounds, best: Best) -> None:
    """The anchor's best rows of its own label in ``block`` enter ``best``."""
    exact = fits(block, q)
    if bounds[1][0][0] + bounds[1][1][0] < best.floor():
        return
    for rest, rows in block.chunks(*bounds):
        rows = rows[(block.label[rows] == label) & ~(block.known[rows] & (block.id[rows] == ident))]
        if len(rows):
            best.add(block.scores(q, rows, exact), block.id[rows], block.known[rows])
        if rest is not None and rest < best.floor():
            return


def find_negatives(block: Block, q: np.ndarray, label: int, bounds, windows: list[tuple[int, Best]], low: int = LOW) -> None:
    """The first rows of other labels in the window of each positive score enter its ``Best``; stops when every window is certified."""
    exact = fits(block, q)
    least = lambda p: -((-low * p) // 100)  # noqa: E731  the smallest score s with low * p <= 100 * s
    windows = [(p, best) for p, best in windows if least(p) <= p]
    if not windows:
        return
    top, bottom = max(p for p, _ in windows), least(min(p for p, _ in windows))
    sure = lambda rest: all(rest < max(best.floor(), least(p)) for p, best in windows)
    if sure(bounds[1][0][0] + bounds[1][1][0]):
        return
    for rest, rows in block.chunks(*bounds):
        rows = rows[block.label[rows] != label]
        score = block.scores(q, rows, exact)
        some = (score <= top) & (score >= bottom)
        if some.any():
            rows, score = rows[some], score[some]
            for p, best in windows:
                fit = (score <= p) & (score >= max(least(p), best.floor()))
                if fit.any():
                    best.add(score[fit], block.id[rows[fit]], block.known[rows[fit]])
        if rest is not None and sure(rest):
            return


def packs(anchors: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Rows of anchors gathered to packs of at most ``size`` in the order of their label: (pack, anchors array)."""
    numbered = anchors.withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy("label", "anchor")
    lot = numbered.withColumn("_lot", F.floor((F.row_number().over(w) - 1) / size))
    return lot.groupBy("_part", "_lot").agg(F.sort_array(F.collect_list(F.struct("label", "anchor", *columns))).alias("anchors")).select(
        (F.col("_part").cast("long") * (1 << 32) + F.col("_lot")).alias("pack"), "anchors")


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", codewords: int = CODEWORDS, sample: int = SAMPLE, block_rows: int = ROWS, anchor_rows: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` takes the id column and tells which rows are anchors.
    """
    spark = prepared(rows.sparkSession)
    items = padded(written(whole_numbers(rows, scale, id_col, vector_col, label_col), "negatives-rows"))
    books = codebooks(items, codewords, sample)
    index = written(blocks(assigned(items, books), block_rows), "negatives-index")
    anchors = written(items.where(F.coalesce(is_anchor(F.col("id")), F.lit(False))).select("id", "label", "v").orderBy("label", "id", "v")
                      .withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")

    def by_block(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """A row for each pair of pack and block, grouped by block: the packs travel, each block stays where it is."""
        return pairs.join(own, "pack").join(index, "block")

    # positives: a pack meets the blocks that hold a label of its anchors
    own = written(packs(anchors, ["id", "v"], anchor_rows), "negatives-packs")
    wanted = own.select("pack", F.explode(F.array_distinct(F.transform("anchors", lambda a: a["label"]))).alias("of"))
    held = index.select("block", F.explode("labels").alias("of"))
    met = by_block(wanted.join(held, "of").select("pack", "block").distinct(), own)

    def positive_rows(batches):
        found: dict[tuple[int], Best] = {}
        for row in _rows(batches):
            block, labels = Block(row, books), set(row["labels"])
            chosen = [a for a in row["anchors"] if a["label"] in labels]
            q = np.array([a["v"] for a in chosen], float).reshape(len(chosen), -1)
            halves = block.half_bounds(q)
            for k, a in enumerate(chosen):
                bounds = [halves[0][0][k], halves[1][0][k]], [halves[0][1][k], halves[1][1][k]]
                find_positives(block, q[k], a["id"], a["label"], bounds, found.setdefault((a["anchor"],), Best(positives)))
            if len(found) > KEPT:
                yield from answers(found, POSITIVE)
                found.clear()
        yield from answers(found, POSITIVE)

    rank = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    first = written(met.mapInArrow(positive_rows, POSITIVE).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= positives), "negatives-positives")

    # negatives: all packs meet all blocks, with the scores of their positives
    # (anchor, list of positive scores): at most ``positives`` in a list
    scores = first.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("p"))
    asking = written(packs(anchors.join(scores, "anchor"), ["v", "p"], anchor_rows), "negatives-windows")
    everywhere = asking.select("pack").crossJoin(index.select("block"))  # the stated query set against all rows, block by block
    met = by_block(everywhere, asking)

    def negative_rows(batches):
        found: dict[tuple[int, int], Best] = {}
        for row in _rows(batches):
            block = Block(row, books)
            chosen = row["anchors"]
            q = np.array([a["v"] for a in chosen], float).reshape(len(chosen), -1)
            halves = block.half_bounds(q)
            for k, a in enumerate(chosen):
                bounds = [halves[0][0][k], halves[1][0][k]], [halves[0][1][k], halves[1][1][k]]
                windows = [(p, found.setdefault((a["anchor"], p), Best(negatives))) for p in a["p"]]
                find_negatives(block, q[k], a["label"], bounds, windows)
            if len(found) > KEPT:
                yield from answers(found, NEGATIVE)
                found.clear()
        yield from answers(found, NEGATIVE)

    rank = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    last = met.mapInArrow(negative_rows, NEGATIVE).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    pairs = first.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(last, ["anchor", "positive_score"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


POSITIVE = "anchor long, score long, id long"
NEGATIVE = "anchor long, positive_score long, negative_score long, negative_id long"


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def answers(found: dict[tuple, Best], schema: str):
    """The rows kept for each key as Arrow batches: the key, score and id."""
    rows = [(*key, -s, None if unknown else i) for key, best in found.items() for s, unknown, i in best.rows]
    names = [c.split()[0] for c in schema.split(", ")]
    for lo in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo:lo + 50_000])], names=names)

"""Language-model scores of texts by a hidden Markov model.

A text is the sequence of its words (A-Z lower-cased) and one end.  Words that make up at least 1 / ``COMMON`` of the training tokens (so
at most ``COMMON`` words) are emission classes of their own; all other words, known or not, belong to one of ``TAILS`` classes by the hash of
their last two code points and share a class's mass by their counts: p(word | state) = p(class | state) * (c + 0.5) / (C + 0.5 * (V + 1)) with the
class's training tokens C and distinct words V.  So every word of the corpus has a probability of its own, while the
parameters that each task needs are bounded by ``COMMON + TAILS`` rows.  Counts of words grow with the corpus and stay distributed.

Baum-Welch: each round every partition runs scaled forward-backward recursions over its training texts and emits expected counts
by class; Spark adds them up.  A text's likelihood is the exact scaled forward recursion, summed over all state sequences.  Texts are
cut into blocks of ``BLOCK`` tokens whose transfer matrices link them, so one very long text is worked on as many are and nothing is cut off.

Defined cases: a null or empty text is one end; a null id is taken as the empty text for the split; repeated rows are scored each; with no
training texts nothing is known and the start model scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tagflow.llm.common import prepared, written
from tagflow.llm.tokens import text_groups, whole

STATES, ROUNDS, COMMON, TAILS, BLOCK, SEED = 8, 3, 32768, 512, 256, 42
#: Blocks worked on together, distinct words counted together, and the weight of the corpus distribution in each state.
TOGETHER, COUNTED, PRIOR = 1024, 200_000, 20.0
#: The end of a text; no word is empty.
END = ""
HELD_OUT = 1


def held_out(doc_id):
    """Whether a row is no training text: crc32 of its id as text leaves 1 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == HELD_OUT


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in a row, offsets with one entry more than texts)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole(texts)))
    words, bounds = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    real = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at the ends gives empty parts
    before = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)), before[bounds - bounds[0]]


def tail_of(words: pa.Array) -> np.ndarray:
    """Tail class (from 0) of words: hash of the last two code points."""
    ends, code = [w[-2:] for w in words.to_pylist()], {}
    for e in set(ends):
        code[e] = xxh64_intdigest(e.encode(), SEED) % TAILS
    return np.fromiter((code[e] for e in ends), np.int64, len(ends))


def tail_column(word):
    """``tail_of`` as a column; TAILS is a power of two, so the sign of the hash doesn't matter."""
    return F.pmod(F.xxhash64(F.substring(word, -2, 2)), F.lit(TAILS)).cast("int")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, c) of the training texts, the end among them under the empty word; words are added up per batch before the shuffle."""
    def counted(batches):
        store, size = [], 0
        def flush():
            t = pa.table({"word": pa.concat_arrays([w for w, _ in store]), "c": pa.array(np.concatenate([c for _, c in store]))})
            t = t.group_by("word").aggregate([("c", "sum")])
            return pa.RecordBatch.from_arrays([t["word"].combine_chunks().cast(pa.string()), t["c_sum"].combine_chunks()], ["word", "c"])
        for b in batches:
            texts = b.column(0)
            for lo, hi in text_groups(texts, 4_000_000):
                coded = pc.dictionary_encode(split_words(texts.slice(lo, hi - lo))[0])
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).astype(np.int64)
                store.append((pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())]), np.append(n, hi - lo)))
                size += len(n) + 1
                if size > COUNTED:
                    yield flush()
                    store, size = [], 0
        if store:
            yield flush()

    prepared(docs.sparkSession)
    train = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    return train.mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What scoring needs of the counts: ``common`` words (at most COMMON) with counts, and the sums of each tail class."""
    common: list[str]
    common_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    words: int

    @property
    def classes(self) -> int:
        return len(self.common) + TAILS

    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.common_counts, self.tail_tokens]).astype(float)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Three bounded results: the sums, at most COMMON words that hold 1 / COMMON of the tokens each, and TAILS class sums."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    often = F.col("c") * COMMON >= total.n
    common = sorted((r.word, r.c) for r in counts.where(often | (F.col("word") == END)).collect())
    tail_tokens, tail_words = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    rest = counts.where(~often & (F.col("word") != END))
    for r in rest.groupBy(tail_column(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        tail_tokens[r.k], tail_words[r.k] = r.c, r.v
    words = [w for w, _ in common] or [END]
    return Vocabulary(words, np.array([c for _, c in common] or [0], np.int64), tail_tokens, tail_words, total.n, total.v)


def encoded(docs: DataFrame, known: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, held_out, n_tokens, classes, common_log, common_known, rest_log, rare, rare_n), one row for each document.

    ``classes`` are the text's classes as unsigned 16-bit numbers; ``common_log`` sums log10(c + 0.5) over its common words, ``rest_log``
    the tail classes' log10(C + 0.5 * (V + 1)), and ``rare`` are its other words with their numbers of occurrences.
    """
    frequent, first = pa.array(known.common, pa.large_string()), len(known.common)
    log_c, seen = np.log10(known.common_counts + 0.5), (known.common_counts > 0).astype(np.int64)
    log_class = np.log10(known.tail_tokens + 0.5 * (known.tail_words + 1))
    end = known.common.index(END)
    kind = docs.schema[id_col].dataType

    def coded(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi in text_groups(b.column(2), 4_000_000):
                words, at = split_words(b.column(2).slice(lo, hi - lo))
                n, docs_n = np.diff(at), hi - lo
                distinct = pc.dictionary_encode(words)
                place = pc.index_in(distinct.dictionary, value_set=frequent)
                is_rare = np.asarray(pc.is_null(place))
                klass = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
                klass[is_rare] = first + tail_of(distinct.dictionary.filter(pa.array(is_rare)))
                which = np.asarray(distinct.indices).astype(np.int64)
                classes = klass[which] if len(which) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(docs_n), n)
                out = np.full(len(classes) + docs_n, end, np.uint16)
                out[np.arange(len(classes)) + doc] = classes
                bounds = at + np.arange(docs_n + 1)
                often = classes < first
                per = lambda v, d: np.bincount(d, weights=v, minlength=docs_n).astype(float)  # noqa: E731  (whole numbers where d is empty)
                common_log = per(log_c[classes[often]], doc[often]) + log_c[end]
                common_known = per(seen[classes[often]], doc[often]).astype(np.int64) + seen[end]
                rest_log = per(log_class[classes[~often] - first], doc[~often])
                # distinct rare words of each document
                pair, times = np.unique(doc[~often] * max(len(distinct.dictionary), 1) + which[~often], return_counts=True)
                rare_doc, rare_word = np.divmod(pair, max(len(distinct.dictionary), 1))
                rare_at = np.searchsorted(rare_doc, np.arange(docs_n + 1)).astype(np.int32)
                rare = distinct.dictionary.take(pa.array(rare_word)).cast(pa.string())
                flat = out.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(docs_n)), b.column(0).slice(lo, docs_n), b.column(1).slice(lo, docs_n), pa.array(n + 1),
                    pa.array([flat[2 * i:2 * j] for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.array(common_log), pa.array(common_known),
                    pa.array(rest_log), pa.ListArray.from_arrays(pa.array(rare_at), rare), pa.ListArray.from_arrays(pa.array(rare_at), pa.array(times.astype(np.int64)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "classes", "common_log", "common_known", "rest_log", "rare", "rare_n"])
                row += docs_n

    prepared(docs.sparkSession)
    schema = (f"row long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, classes binary, common_log double, common_known long, "
              "rest_log double, rare array<string>, rare_n array<long>")
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return written(own.mapInArrow(coded, schema), "lm-encoded")


@dataclass
class Hmm:
    start: np.ndarray    # (S)
    move: np.ndarray     # (S, S) from, to
    emit: np.ndarray     # (S, K)


def first_model(known: Vocabulary, states: int = STATES) -> Hmm:
    """Start: corpus shares of the classes, moved a little apart in each state by a seeded draw; states are sticky."""
    share = class_shares(known)
    draw = np.random.default_rng(SEED).random((states, known.classes))
    emit = share * (0.25 + 1.5 * draw)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def class_shares(known: Vocabulary) -> np.ndarray:
    c = known.class_counts() + 0.5
    return c / c.sum()


class Blocks:
    """Texts as blocks of at most ``block`` classes, with the links between them.

    Blocks with a next one, all of the full size, come first (``linked`` of them), then the last blocks of texts, longest first; so the
    blocks that have a token at a step are the first ``live[step]``.
    """

    def __init__(self, texts: list[np.ndarray], block: int):
        flat = np.concatenate(texts)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        per = -(-n // block)
        doc = np.repeat(np.arange(len(n)), per)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(n) - n, per) + rank * block
        last = rank == per[doc] - 1
        size = np.where(last, n[doc] - rank * block, block)
        order = np.lexsort((-size, last))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.n_docs, self.doc, self.rank, self.size = len(n), doc[order], rank[order], size[order]
        self.linked = int((~last).sum())
        self.next = place[order[:self.linked] + 1]
        self.width = int(self.size.max())
        step = np.arange(self.width + 1)
        self.live = self.linked * (step < block) + np.searchsorted(-self.size[self.linked:], -step, side="left")
        self.ids = np.ascontiguousarray(flat[np.minimum(begin[order][:, None] + step[:-1], len(flat) - 1)].T)
        by_rank = np.argsort(-self.rank[:self.linked], kind="stable")
        cut = np.flatnonzero(np.diff(self.rank[by_rank])) + 1
        self.waves = np.split(by_rank, cut) if self.linked else []  # linked blocks of equal rank, last ranks first


def transfers(b: Blocks, m: Hmm) -> np.ndarray:
    """Scaled transfer matrices (linked blocks, S, S): state before the block's tokens to state before the next block's."""
    s, n = len(m.start), b.linked
    out = np.broadcast_to(np.eye(s, dtype=m.emit.dtype), (n, s, s)).copy()
    rows = np.ascontiguousarray(m.emit.T)
    for t in range(b.width if n else 0):
        out *= rows[b.ids[t, :n], None, :]
        out = (out.reshape(n * s, s) @ m.move).reshape(n, s, s)
        if t % 4 == 3 or t == b.width - 1:
            out /= out.max(axis=(1, 2), keepdims=True)
    return out


def entries(b: Blocks, m: Hmm, through: np.ndarray) -> np.ndarray:
    """State distribution before each block's first token."""
    e = np.broadcast_to(m.start, (len(b.size), len(m.start))).copy()
    for now in reversed(b.waves):
        step = np.einsum("ni,nij->nj", e[now], through[now])
        e[b.next[now]] = step / step.sum(1, keepdims=True)
    return e


def forward(b: Blocks, m: Hmm, e: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(log10 likelihood of each text's classes, scaled state vectors (step, block, S) if kept)."""
    rows, s = np.ascontiguousarray(m.emit.T), len(m.start)
    kept = np.zeros((b.width, len(b.size), s), m.emit.dtype) if keep else None
    scale, one = np.ones((b.width, len(b.size))), np.ones(s, m.emit.dtype)
    for t in range(b.width):
        n = b.live[t]
        a = np.multiply(e[:n], rows[b.ids[t, :n]], out=kept[t, :n] if keep else None)
        total = a @ one
        a *= (1 / total)[:, None]
        scale[t, :n] = total
        e = a @ m.move
    return np.bincount(b.doc, weights=np.log10(scale).sum(0), minlength=b.n_docs), kept


def expected(texts: list[np.ndarray], m: Hmm, block: int = BLOCK) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 likelihood, expected starts (S), moves (S, S), emissions (S, K)) of texts, each of one class at least."""
    b = Blocks(texts, block)
    s, k = m.emit.shape
    through = transfers(b, m)
    log, soft = forward(b, m, entries(b, m, through), True)
    ahead = np.ones((len(b.size), s), m.emit.dtype)  # for linked blocks: likelihood of the rest by the state of the next block's first token
    starts = np.ones((len(b.size), s), m.emit.dtype)  # likelihood of a block's tokens and the rest by the state of its first token
    moves, rows, back = np.zeros((s, s)), np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    one = np.ones(s, m.emit.dtype)

    def walk(lo: int, hi: int) -> np.ndarray:
        """Walks back through blocks lo to hi and counts; the scaled state vectors become posteriors.  Returns their ``starts``."""
        r = ahead[lo:hi].copy()
        for t in range(b.width - 1, -1, -1):
            n = min(int(b.live[t]), hi) - lo
            if n <= 0:
                continue
            go = n if hi <= b.linked else min(int(b.live[t + 1]), hi) - lo  # tokens with one behind them
            now, on = soft[t, lo:lo + n], np.ones((n, s), m.emit.dtype)
            if go > 0:
                on[:go] = r[:go] @ back
            share = (1 / ((now * on) @ one))[:, None]
            now *= share
            if go > 0:
                moves[:] += now[:go].T @ r[:go]
            now *= on
            on *= rows[b.ids[t, lo:lo + n]]
            np.multiply(on, (1 / (on @ one))[:, None], out=r[:n])
        return r

    # the transfer matrices lead from a block's end to its start, so one pass walks the last blocks and one all others
    starts[b.linked:] = walk(b.linked, len(b.size))
    for now in b.waves:
        ahead[now] = starts[b.next[now]]
        step = np.einsum("nij,nj->ni", through[now], ahead[now])
        starts[now] = step / step.max(1, keepdims=True)
    if b.linked:
        walk(0, b.linked)
    begun = soft[0, b.rank == 0].sum(0, dtype=float)
    real = np.arange(b.width)[:, None] < b.size[None, :]
    ids, soft = b.ids[real], soft[real]
    counts = np.stack([np.bincount(ids, weights=soft[:, j], minlength=k) for j in range(s)])
    return float(log.sum()), begun, moves * m.move, counts


def groups_of(codes: list[bytes], block: int):
    """Slices of texts with at most TOGETHER blocks, or one text."""
    lo, n = 0, 0
    for i, c in enumerate(codes):
        more = -(-len(c) // (2 * block))
        if i > lo and n + more > TOGETHER:
            yield lo, i
            lo, n = i, 0
        n += more
    if len(codes) > lo:
        yield lo, len(codes)


def _texts(codes: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16).astype(np.int64) for c in codes]


def baum_welch_round(table: DataFrame, m: Hmm, known: Vocabulary, block: int = BLOCK) -> tuple[Hmm, float]:
    """One round over all training texts: (new model, log10 likelihood of their classes under the old one).

    Counts are found with 32-bit vectors, scaled at every token, and added up in 64 bits; scoring itself uses 64 bits.
    """
    states, k = m.emit.shape
    m = Hmm(*[x.astype(np.float32) for x in (m.start, m.move, m.emit)])

    def counted(batches):
        total = [0.0, np.zeros(states), np.zeros((states, states)), np.zeros((states, k))]
        for b in batches:
            codes = sorted(b.column(0).to_pylist(), key=len)
            for lo, hi in groups_of(codes, block):
                for t, x in zip(range(4), expected(_texts(codes[lo:hi]), m, block)):
                    total[t] = total[t] + x
        seen = np.flatnonzero(total[3].sum(0))
        key = np.concatenate([seen, -1 - np.arange(states), [-1 - states, -2 - states]])
        value = np.concatenate([total[3][:, seen].T, total[2], total[1][None, :], np.full((1, states), total[0])])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *[pa.array(np.ascontiguousarray(value[:, j])) for j in range(states)]],
                                         names=["key", *[f"s{j}" for j in range(states)]])

    schema = "key long, " + ", ".join(f"s{j} double" for j in range(states))
    parts = table.where(~F.col("held_out")).select("classes").mapInArrow(counted, schema)
    sums = parts.groupBy("key").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)])
    got = {r[0]: np.array(r[1:], float) for r in sums.collect()}  # at most COMMON + TAILS + STATES + 2 rows
    move = np.stack([got.get(-1 - i, np.zeros(states)) for i in range(states)]) + 1.0 / states
    begun = got.get(-1 - states, np.zeros(states)) + 1.0 / states
    emit = PRIOR * class_shares(known) * np.ones((states, 1))
    for key, v in got.items():
        if key >= 0:
            emit[:, key] += v
    log = float(got.get(-2 - states, np.zeros(1))[0])
    return Hmm(begun / begun.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)), log


def train(table: DataFrame, known: Vocabulary, rounds: int = ROUNDS, states: int = STATES, block: int = BLOCK) -> tuple[Hmm, list[float]]:
    """(model after ``rounds`` of Baum-Welch, the training likelihood before each round)."""
    m, history = first_model(known, states), []
    for _ in range(rounds):
        m, log = baum_welch_round(table, m, known, block)
        history.append(log)
    return m, history


def rare_logs(table: DataFrame, counts: DataFrame, known: Vocabulary) -> DataFrame:
    """(row, rare_log, rare_known): log10(c + 0.5) and occurrences with c > 0 summed over a document's rare words.

    Each rare word holds under 1 / COMMON of the training tokens, so no key of this join is hot.
    """
    rest = counts.where((F.col("c") * COMMON < known.tokens) & (F.col("word") != END)).select("word", F.log10(F.col("c") + 0.5).alias("log_c"))
    pairs = table.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    met = pairs.join(rest.hint("shuffle_hash"), "word", "left")
    return met.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("log_c", F.lit(float(np.log10(0.5))))).alias("rare_log"),
                                  F.sum(F.when(F.col("log_c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, states: int = STATES, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text) of every document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # texts pass through the workers in smaller lots
    counts = written(word_counts(docs, id_col, text_col), "lm-counts")
    known = vocabulary(counts)
    table = encoded(docs, known, id_col, text_col)
    model, _ = train(table, known, rounds, states, block)

    def scored(batches):
        for b in batches:
            codes = b.column(1).to_pylist()
            order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
            log = np.zeros(len(codes))
            ordered = [codes[i] for i in order]
            for lo, hi in groups_of(ordered, block):
                x = Blocks(_texts(ordered[lo:hi]), block)
                log[order[lo:hi]] = forward(x, model, entries(x, model, transfers(x, model)), False)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in range(2, 8)], pa.array(log)], names=names)

    kept = ["row", "doc_id", "held_out", "n_tokens", "common_log", "common_known", "rest_log"]
    names = [*kept, "hmm"]
    kind = table.schema["doc_id"].dataType.simpleString()
    hmm = table.select("row", "classes", *kept[1:]).mapInArrow(
        scored, f"row long, doc_id {kind}, held_out boolean, n_tokens long, common_log double, common_known long, rest_log double, hmm double")
    of_word = float(np.log10(known.tokens + 0.5 * (known.words + 1)))
    rare = F.coalesce("rare_log", F.lit(0.0))
    return hmm.join(rare_logs(table, counts, known), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("common_log") + rare - F.col("n_tokens") * of_word).alias("base_score"),
        (F.col("hmm") + rare - F.col("rest_log")).alias("score"))

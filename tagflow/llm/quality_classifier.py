"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the counted vote patterns estimates their accuracies
without any gold label (``quality_rules.fit``).  The posteriors are the soft labels of a hashed linear scorer: words, and the shapes of words that
aren't plain lower case, are hashed into ``FEATURES`` buckets and counted, and a logistic regression is fitted on a bounded sample of
``TRAIN_ROWS`` documents in expectation, chosen by the hash of their ids and texts.  Every document's whole text is then scored.

Each text is split once: one pass counts what the labellers look at and the hashed words together, and later steps read its table.  Whatever
depends on a word alone is found once for each distinct word of a batch.

Defined cases: null and empty texts score as bad (they have no features and no labeller speaks for them); repeated rows score alike; null ids are
kept; an empty table gives no rows; a table whose weak labels are all alike scores by the model's prior; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tagflow.llm import quality_rules as rules
from tagflow.llm.common import prepared, written
from tagflow.llm.tokens import text_groups, whole

FEATURES, TRAIN_ROWS, ITERATIONS, RIDGE, SEED = 1 << 16, 20_000, 30, 1e-4, 42

LABELLERS = ["function_words", "symbols", "dup_lines", "repeats", "upper", "shouts", "long_words"]
COUNTED = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_function", "n_shouts", "n_long"]


def bucket(token: str) -> int:
    return xxh64_intdigest(token.encode("utf-8", "surrogatepass"), SEED) % FEATURES


def _pairs(doc: np.ndarray, what: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, thing, times) of each distinct pair, in order of document."""
    pair, times = np.unique(doc * kinds + what, return_counts=True)
    return (*np.divmod(pair, kinds), times)


def repeated(doc: np.ndarray, word: np.ndarray, docs: int, n: int = 3) -> np.ndarray:
    """For each document the words inside ``n``-word windows that are found twice or more in it."""
    last = len(word) - n + 1
    if last < 1:
        return np.zeros(docs, np.int64)
    inside = doc[:last] == doc[n - 1:]
    at = np.flatnonzero(inside)
    code = word[at]
    for k in range(1, n):  # windows as numbers: pairs of a window's number and the next word, numbered anew
        code = np.unique(code * (int(word.max()) + 1) + word[at + k], return_inverse=True)[1]
    _, which, times = np.unique(doc[at] * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
    hit = at[times[which] > 1]
    covered = np.zeros(len(word), bool)
    for k in range(n):
        covered[hit + k] = True
    return np.bincount(doc[covered], minlength=docs)


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them equal to an earlier one) of each text."""
    parts = pc.split_pattern(texts, "\n")
    bounds = np.asarray(parts.offsets).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    coded = pc.dictionary_encode(parts.flatten())
    real = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0))
    which = np.asarray(coded.indices).astype(np.int64)
    keep = real[which] if len(which) else np.zeros(0, bool)
    lines = np.bincount(doc[keep], minlength=len(texts))
    distinct, _, _ = _pairs(doc[keep], which[keep], max(len(real), 1))
    return lines, lines - np.bincount(distinct, minlength=len(texts))


def counts_of(texts: pa.Array) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(the counts of each text, its buckets, their counts)."""
    texts = whole(texts)
    docs = len(texts)
    parts = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(docs), np.diff(np.asarray(parts.offsets).astype(np.int64)))
    coded = pc.dictionary_encode(parts.flatten())
    words, word = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    if len(words):  # white space at the ends of a text gives empty parts
        real = np.asarray(pc.greater(pc.binary_length(words), 0))
        doc, word = doc[real[word]], word[real[word]]
    length = np.asarray(pc.utf8_length(words)).astype(np.int64)
    found = lambda pattern: np.asarray(pc.count_substring_regex(words, pattern)).astype(np.int64)
    of_word = {"n_words": np.ones(len(words), np.int64), "word_chars": length, "n_symbols": found(r"[#*$%&|<>]"), "n_upper": found(r"\p{Lu}"),
               "n_function": np.asarray(pc.is_in(words, value_set=pa.array(rules.FUNCTION_WORDS, pa.large_string()))).astype(np.int64),
               "n_shouts": np.asarray(pc.ends_with(words, "!")).astype(np.int64), "n_long": (length > 25).astype(np.int64)}
    which, kind, times = _pairs(doc, word, max(len(words), 1))
    out = {c: np.bincount(which, weights=v[kind] * times, minlength=docs).astype(np.int64) for c, v in of_word.items()}
    out["n_repeat_words"] = repeated(doc, word, docs)
    out["n_lines"], out["n_dup_lines"] = duplicate_lines(texts)
    # buckets of the words, and of the shapes of odd ones
    plain = np.asarray(pc.match_substring_regex(words, r"^\p{Ll}+$"))
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(words.filter(pa.array(~plain)), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    own = np.fromiter((bucket(w) for w in words.to_pylist()), np.int64, len(words))
    shaped = pc.dictionary_encode(shapes)
    shape = np.fromiter((bucket("\u0001" + s) for s in shaped.dictionary.to_pylist()), np.int64, len(shaped.dictionary))
    of_odd = np.full(len(words), -1)
    of_odd[~plain] = shape[np.asarray(shaped.indices)] if len(shape) else -1
    odd = of_odd[kind] >= 0
    pair = np.concatenate([which * FEATURES + own[kind], which[odd] * FEATURES + of_odd[kind][odd]])
    pair, at = np.unique(pair, return_inverse=True)
    number = np.bincount(at, weights=np.concatenate([times, times[odd]]), minlength=len(pair))
    cut = np.searchsorted(pair, np.arange(1, docs) * FEATURES)
    return out, np.split(pair % FEATURES, cut), np.split(number, cut)


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), the counts, buckets and numbers (bytes of unsigned 16-bit and 32-bit float numbers)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def passed(batches):
        for b in batches:
            for lo, hi in text_groups(b.column(2), 4_000_000):
                counts, buckets, numbers = counts_of(b.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *[pa.array(counts[c]) for c in COUNTED],
                    pa.array([x.astype(np.uint16).tobytes() for x in buckets], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in numbers], pa.binary())],
                    names=["doc_id", "h", *COUNTED, "buckets", "numbers"])

    prepared(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(passed, f"doc_id {kind}, h long, " + ", ".join(f"{c} long" for c in COUNTED) + ", buckets binary, numbers binary")


@F.udf(VectorUDT())
def sparse(buckets, numbers):
    """Feature vector of a sampled document."""
    return SparseVector(FEATURES, np.frombuffer(buckets, np.uint16).astype(np.int32), np.frombuffer(numbers, np.float32).astype(float))


def fitted(table: DataFrame, weak, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float] | None:
    """(weights, intercept) of the scorer fitted on the posteriors of about ``rows`` documents, or None where all are alike."""
    share = min(1.0, rows / max(table.count(), 1))
    chosen = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), F.col("h")), F.lit(1 << 30)) < int(share * (1 << 30))
    soft = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
    sample = table.where(chosen).select("buckets", "numbers", weak.alias("p")).select("buckets", "numbers", soft.alias("s"))
    train = written(sample.select("buckets", "numbers", "s.*").where("w > 0"), "classifier-train")
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    model = LogisticRegression(maxIter=ITERATIONS, regParam=RIDGE, weightCol="w").fit(train.select(sparse("buckets", "numbers").alias("features"), "label", "w"))
    return model.coefficients.toArray(), model.intercept


def classify(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (of the linear scorer) and kept."""
    table = written(counted(docs, id_col, text_col), "classifier-counts").select("*", *[rules.vote(r).alias(r) for r in LABELLERS])
    model = rules.fit(table, LABELLERS)
    scorer = fitted(table, F.when(F.col("n_words") == 0, 0.0).otherwise(rules.posterior(model, LABELLERS)))
    blank = F.col("n_words") == 0
    if scorer is None:
        scored = table.select("doc_id", F.when(blank, 0.0).otherwise(float(model["prior"])).alias("score"))
    else:
        weights, intercept = scorer

        def summed(batches):
            for b in batches:
                numbers = [np.frombuffer(x, np.float32) for x in b.column(2).to_pylist()]
                at = np.repeat(np.arange(b.num_rows), [len(x) for x in numbers])
                found = weights[np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16)] * np.concatenate([np.zeros(0), *numbers])
                total = intercept + np.bincount(at, weights=found, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=["doc_id", "n_words", "s"])

        kind = table.schema["doc_id"].dataType.simpleString()
        scored = table.select("doc_id", "buckets", "numbers", "n_words").mapInArrow(summed, f"doc_id {kind}, n_words long, s double")
        scored = scored.select("doc_id", F.when(blank, 0.0).otherwise(F.col("s")).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))

"""Span alignment: project entity spans onto a token sequence as BIO tags.

Semantics (kept from the reference pipeline):
  * the text is normalised and tokenised whole; with an explicit ``max_len`` it is
    truncated *before* alignment, so a span past or across the cut is dropped;
  * each span is matched at its *first* token-level occurrence in the
    (truncated) sequence;
  * spans are written in order, so at a position covered by several spans
    the span with the highest index wins;
  * a span that tokenises to nothing is skipped.

Relational form (no per-position array lambdas):
  A1  entity tokens (doc, j, k, tok) JOIN tokens (doc, pos, tok) ON doc, tok,
      GROUP BY doc, j, pos-k HAVING count(*) = n  -> candidates; min(start).
  A2  explode covered positions, max_by(tag, j) per (doc, pos), LEFT JOIN tokens.

Physical plan: documents are hash-partitioned on ``doc_id`` once; both joins and
all aggregations then run inside those partitions (no further exchange of the
token table; hash tables are built on the small entity/tag sides).  A document
is the unit of work: its tokens stream through one task, and its text must fit
there (Spark's own bound of a string cell, 2 GB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.functions.text import word_tokens
from tagflow.schema import ENTITY_TYPES, N_TYPES, OUTSIDE_ID, label_to_id

TEXT_PER_TASK = 4 << 20  # bytes of text whose tokens one task sorts and joins


def text_partitions(docs: DataFrame, text_col: str = "text", per_task: int = TEXT_PER_TASK) -> int | None:
    """Partitions that hold about ``per_task`` bytes of text each (one aggregate over the text column); None where one for each core is enough,
    which Spark's own number and merging keep to."""
    held = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = -(-held // per_task)
    return parts if parts > docs.sparkSession.sparkContext.defaultParallelism else None


def by_doc(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_task: int = TEXT_PER_TASK) -> DataFrame:
    """Hash-partition documents on their id: the only exchange of the doc-local plan.

    The number of partitions grows with the text, so a task's sorts and hash tables stay as small on a large corpus: partitions of a fixed number, or
    merged by their compressed bytes, would hold ever more tokens.

    The raw text is shuffled instead of the exploded tokens (fewer bytes, and
    tokenisation then runs with full parallelism after the exchange).  A null id
    fails the job instead of losing the document.  The not-null filter behind the
    check keeps the optimizer from inferring different filters on different
    consumers, so every consumer reuses this exchange.
    """
    checked = F.coalesce(F.col(id_col), F.raise_error(F.lit(f"{id_col} must not be null")).cast(docs.schema[id_col].dataType))
    parts = text_partitions(docs, text_col, per_task)
    return docs.withColumn(id_col, checked).where(F.col(id_col).isNotNull()).repartition(*([parts] if parts else []), id_col)


def tokens(docs: DataFrame, max_len: int | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, pos, tok): one row per token, ``pos`` 0-based, cut only at an explicit ``max_len``.

    Keeps the input partitioning (pass documents through ``by_doc`` first).
    """
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.posexplode_outer(word_tokens(text_col, max_len)).alias("pos", "tok"))
            .where(F.col("tok").isNotNull()))


def span_rows(span_docs: DataFrame) -> DataFrame:
    """(doc_id, j, text, label): one row per span, j = index in the document's list."""
    # *_outer + null filter: a plain posexplode makes the optimizer infer
    # size(spans) > 0 below the projection, re-evaluating the spans expression
    return (span_docs.select("doc_id", F.posexplode_outer("spans").alias("j", "span"))
            .where(F.col("span").isNotNull())
            .select("doc_id", "j", F.col("span.text").alias("text"), F.col("span.label").alias("label")))


def entity_tokens(spans: DataFrame) -> DataFrame:
    """(doc_id, j, label, n, k, tok): the tokens of each span, k 0-based, n = count."""
    et = spans.select("doc_id", "j", "label", word_tokens("text").alias("_et"))
    return (et.select("doc_id", "j", "label", F.size("_et").alias("n"),
                      F.posexplode_outer("_et").alias("k", "tok"))
            .where(F.col("tok").isNotNull()))


def locate_spans(toks: DataFrame, ent: DataFrame) -> DataFrame:
    """A1: (doc_id, j, label, n, s) with s the first start where all n tokens match."""
    hits = ent.hint("shuffle_hash").join(toks, ["doc_id", "tok"])
    cand = (hits.groupBy("doc_id", "j", "label", "n", (F.col("pos") - F.col("k")).alias("s"))
            .agg(F.count(F.lit(1)).alias("m"))
            .where(F.col("m") == F.col("n")))
    return cand.groupBy("doc_id", "j", "label", "n").agg(F.min("s").cast("int").alias("s"))


def tag_id_expr(prefix_b: F.Column, label: F.Column) -> F.Column:
    """B-x -> 1+idx(x), I-x -> 1+14+idx(x) (idx by the fixed entity type order)."""
    types = F.array(*[F.lit(t) for t in ENTITY_TYPES])
    idx = F.array_position(types, label).cast("int") - 1
    return F.when(prefix_b, 1 + idx).otherwise(1 + N_TYPES + idx)


def id_to_tag_expr(tag_id: F.Column) -> F.Column:
    """Label id -> label string through a 30-entry literal array (no join)."""
    names = [name for name, _ in sorted(label_to_id().items(), key=lambda kv: kv[1])]
    return F.element_at(F.array(*[F.lit(n) for n in names]), tag_id + 1)


def span_positions(located: DataFrame) -> DataFrame:
    """A2 step 1: (doc_id, pos, j, tag_id) for every position a located span covers."""
    p = located.select("doc_id", "j", "label", "s",
                       F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("pos"))
    return p.select("doc_id", "pos", "j", tag_id_expr(F.col("pos") == F.col("s"), F.col("label")).alias("tag_id"))


def bio_from_located(toks: DataFrame, located: DataFrame) -> DataFrame:
    """A2: last span wins per position; uncovered tokens are O.

    The winner is ``max_by(tag_id, j)`` over fixed-width ints, so the
    aggregation stays a (partial) hash aggregate; the string is derived after.
    """
    g = span_positions(located).groupBy("doc_id", "pos").agg(F.max_by("tag_id", "j").alias("tag_id"))
    bio = toks.join(g.hint("shuffle_hash"), ["doc_id", "pos"], "left")
    tag_id = F.coalesce("tag_id", F.lit(OUTSIDE_ID)).cast("int")
    return bio.select("doc_id", F.col("pos").cast("int").alias("pos"), "tok",
                      id_to_tag_expr(tag_id).alias("tag"), tag_id.alias("tag_id"))


def align(span_docs: DataFrame, max_len: int | None = None, partitioned: bool = False) -> DataFrame:
    """Span documents (doc_id, text, spans) -> (doc_id, pos, tok, tag, tag_id).

    ``partitioned=True`` says the input already went through ``by_doc``.
    """
    sd = span_docs if partitioned else by_doc(span_docs)
    toks = tokens(sd, max_len)
    located = locate_spans(toks, entity_tokens(span_rows(sd)))
    return bio_from_located(toks, located)

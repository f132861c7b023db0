"""Span documents: raw annotation records -> one row per document with its spans.

P1 text extraction, P2 span flattening, P3 span-document assembly (documents
without spans are kept), P4 invalid-label quarantine, P5 section union.
All operators are row-local except P4 (one anti join against the documents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.schema import ENTITY_TYPES

SPAN_ARRAY_TYPE = "array<struct<start:int,end:int,text:string,label:string>>"


def flatten_spans(annotations: F.Column) -> F.Column:
    """All results of all annotations, in order, as (start, end, text, first label)."""
    nested = F.transform(annotations, lambda a: F.transform(a["result"], lambda r: F.struct(
        r["value"]["start"].alias("start"),
        r["value"]["end"].alias("end"),
        r["value"]["text"].alias("text"),
        F.try_element_at(r["value"]["labels"], F.lit(1)).alias("label"))))
    return F.coalesce(F.flatten(nested), F.array().cast(SPAN_ARRAY_TYPE))


def span_extract(raw: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """P1+P3: raw records (``id_col``, data.text, annotations) -> (doc_id, text, spans[, ``keep`` columns])."""
    return raw.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col("data.text").alias("text"),
                      flatten_spans(F.col("annotations")).alias("spans"), *(keep or []))


def span_rows(span_docs: DataFrame) -> DataFrame:
    """(doc_id, j, start, end, text, label), one row per span; no row for span-less documents."""
    return (span_docs.select("doc_id", F.posexplode_outer("spans").alias("j", "s"))
            .where(F.col("s").isNotNull())
            .select("doc_id", "j", "s.start", "s.end", "s.text", "s.label"))


def span_counts(span_docs: DataFrame) -> DataFrame:
    """P3 check: every document with its number of spans (0 kept)."""
    return span_docs.select("doc_id", F.size("spans").cast("int").alias("n_spans"))


def valid_label(label: F.Column) -> F.Column:
    return label.isNotNull() & F.array_contains(F.array(*[F.lit(t) for t in ENTITY_TYPES]), label)


def invalid_label_docs(span_docs: DataFrame) -> DataFrame:
    """Ids of documents with at least one span whose label is unknown or missing.

    Row-local (``exists`` over the document's own span array): no shuffle.
    """
    bad = F.exists("spans", lambda s: ~valid_label(s["label"]))
    return span_docs.where(bad).select("doc_id")


def drop_invalid_label_docs(span_docs: DataFrame) -> DataFrame:
    """Keep only documents whose labels are all in the dictionary (quarantine the rest)."""
    return span_docs.where(~F.exists("spans", lambda s: ~valid_label(s["label"])))


def section_union(sections: dict, ids: str = "number", id_col: str = "doc_id") -> DataFrame:
    """P5: UNION ALL by column name, in the given order, tagging each part with ``section`` (keys: section, or (split, section)).

    Everything after this joins on ``id_col`` alone, so an id must mean one document over all parts.  ``ids="number"`` moves each part's ids
    behind those of the parts before it (one small aggregate per part; parts numbered 0, 1, ... give 0, 1, ... over all) and
    keeps the part's own in ``part_id``; ``ids="keep"`` leaves ids as they are.  An id that is null or stands in two documents raises.
    """
    if ids not in ("number", "keep"):
        raise ValueError(f"ids: {ids!r}")
    parts, first = [], 0
    for name, df in sections.items():
        split, section = name if isinstance(name, tuple) else (None, name)
        if ids == "number":
            least, most = df.agg(F.min(id_col), F.max(id_col)).first()
            least = least or 0
            df = df.withColumn("part_id", F.col(id_col)).withColumn(id_col, (F.col(id_col) - F.lit(least) + F.lit(first)).cast("long"))
            first += most - least + 1 if most is not None else 0
        if split is not None:
            df = df.withColumn("split", F.lit(split))
        parts.append(df.withColumn("section", F.lit(section)))
    united = reduce(lambda a, b: a.unionByName(b), parts)
    twice = united.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(5).collect()
    if twice:
        raise ValueError(f"{id_col} must be one document's own over all sections: {[r[0] for r in twice]}")
    return united

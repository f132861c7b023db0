"""Annotation JSON scan, span-document sink/source, legacy list-literal import."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.operators.ids import FILE_ORDER, dense_index, file_order
from tagflow.operators.spans import section_union, span_extract
from tagflow.schema import RAW_ANNOTATION, SPAN_DOCS


def read_annotations(spark: SparkSession, path: str, split: str | None = None, section: str | None = None,
                     multi_line: bool = False) -> DataFrame:
    """Annotation records with an explicit schema -> span documents.

    ``doc_id`` is the record's number in (file, position) order; the record's own id, if it has one, stays as text
    in ``source_id``.  ``multi_line=True`` reads one JSON array per file (one task per file); for
    large inputs convert once to JSON lines or Parquet, which split freely.
    """
    raw = file_order(spark.read.schema(RAW_ANNOTATION).option("multiLine", multi_line).json(path))
    numbered = dense_index(raw.withColumnRenamed("id", "source_id"), FILE_ORDER, "doc_id")
    out = span_extract(numbered, keep=["source_id"])
    if split is not None:
        out = out.withColumn("split", F.lit(split))
    if section is not None:
        out = out.withColumn("section", F.lit(section))
    return out


def read_sections(spark: SparkSession, paths: dict[tuple[str, str], str], multi_line: bool = False) -> DataFrame:
    """S1+P5: the annotation files of several (split, section) pairs as one table of span documents.

    ``doc_id`` numbers the documents over all files, in the order of ``paths``, then (file, position); the number within a part is ``part_id``.
    """
    return section_union({k: read_annotations(spark, path, multi_line=multi_line) for k, path in paths.items()})


def parse_annotations(json_col: F.Column) -> F.Column:
    """Parse one annotation record held in a string column."""
    return F.from_json(json_col, RAW_ANNOTATION)


def write_spans(span_docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Span documents as Parquet, partitioned by split/section when present."""
    parts = [c for c in ("split", "section") if c in span_docs.columns]
    w = span_docs.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """S3: Parquet span documents (split/section come back as partition columns)."""
    return spark.read.parquet(path)


def _literal(v):
    """Python list literal (legacy CSV cell) -> list of strings."""
    if v is None:
        return None
    parsed = ast.literal_eval(v)
    if not isinstance(parsed, (list, tuple)):
        raise ValueError(f"not a list literal: {v[:80]!r}")
    return [None if x is None else str(x) for x in parsed]


def read_legacy_spans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3 legacy: CSV files with an index column, ``overall_text`` and list literals in ``start,end,text,label`` -> span documents.

    Every file counts its index from 0, so ``doc_id`` is the row's number in (file, position) order; the index stays in ``source_id``.
    Several paths are numbered as one list, sorted by file; ``section_union`` joins parts that are read apart.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .csv(path))
    numbered = dense_index(file_order(raw.withColumnRenamed(raw.columns[0], "source_id")), FILE_ORDER, "doc_id")
    return legacy_to_span_docs(numbered, keep=["source_id"])


_CELLS = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("start", "end", "text", "label")])


@F.pandas_udf(_CELLS)
def parse_cells(start: pd.Series, end: pd.Series, text: pd.Series, label: pd.Series) -> pd.DataFrame:
    """The four list-literal cells of a row in one Python call per batch."""
    return pd.DataFrame({c: s.map(_literal) for c, s in zip(_CELLS.names, (start, end, text, label))})


def legacy_to_span_docs(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    cells = parse_cells("start", "end", "text", "label")
    spans = F.arrays_zip(cells["start"].alias("start"), cells["end"].alias("end"), cells["text"].alias("text"), cells["label"].alias("label"))
    spans = F.transform(spans, lambda z: F.struct(z["start"].cast("int").alias("start"), z["end"].cast("int").alias("end"),
                                                  z["text"].alias("text"), z["label"].alias("label")))
    return raw.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("overall_text").alias("text"),
                      spans.alias("spans"), *(keep or []))


SPAN_DOCS_SCHEMA = SPAN_DOCS

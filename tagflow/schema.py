"""Data model: label dictionary, nested annotation schema, span structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical ids.
# Entity types in id order: B-<type> takes ids 1..14 and I-<type> ids 15..28
# in this order; "O" is 0 and the pad label is 29.
ENTITY_TYPES = [
    "COURT", "PETITIONER", "RESPONDENT", "JUDGE", "LAWYER", "DATE", "ORG",
    "GPE", "STATUTE", "PROVISION", "PRECEDENT", "CASE_NUMBER", "WITNESS",
    "OTHER_PERSON",
]
OUTSIDE = "O"
OUTSIDE_ID = 0
PAD_LABEL = "<PAD>"          # word-level pad label name
PAD_LABEL_SUBWORD = "[PAD]"  # subword-level pad label name
PAD_ID = 29
# ---------------------------------------------------------------------------

N_TYPES = len(ENTITY_TYPES)
NUM_TAGS = 2 * N_TYPES + 2  # O, B-*, I-*, pad


def label_to_id(pad_name: str = PAD_LABEL) -> dict[str, int]:
    """The 30-entry label dictionary, built from the entity type order."""
    d = {OUTSIDE: OUTSIDE_ID}
    for i, t in enumerate(ENTITY_TYPES):
        d[f"B-{t}"] = 1 + i
    for i, t in enumerate(ENTITY_TYPES):
        d[f"I-{t}"] = 1 + N_TYPES + i
    d[pad_name] = PAD_ID
    return d


def id_to_label(pad_name: str = PAD_LABEL) -> dict[int, str]:
    return {v: k for k, v in label_to_id(pad_name).items()}


def labels_df(spark: SparkSession, pad_name: str = PAD_LABEL) -> DataFrame:
    """Label dictionary as a two-column table (label, label_id); 30 rows, always broadcast."""
    rows = sorted(label_to_id(pad_name).items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, "label string, label_id int")


def entity_types_sql() -> str:
    """The entity type list as a SQL array literal (same text for Spark and DuckDB)."""
    return "[" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + "]"


# Raw annotation record: only the fields the pipeline reads are declared.  ``id`` may be missing, a
# number or a string; it is carried as text and never used as a key (rows are positional).
SPAN_VALUE = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])
RAW_ANNOTATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("data", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("value", SPAN_VALUE),
        ]))),
    ]))),
])

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
])

SPAN_DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.ArrayType(SPAN)),
])

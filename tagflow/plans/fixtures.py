"""Fixtures derived by Spark from the driver tables (documented in FIXTURES.md).

The reference ships no data; these rules turn ``documents`` into annotated
documents so every operator runs over whole tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagflow.functions.text import whitespace_words
from tagflow.schema import ENTITY_TYPES
from tagflow.session import scratch

SPANS_PER_DOC = 3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def split_of(doc_id: F.Column) -> F.Column:
    """Deterministic train/dev split of a document id (every fifth id is dev)."""
    return F.when(doc_id % 5 == 0, F.lit("dev")).otherwise(F.lit("train"))


def span_docs(docs: DataFrame) -> DataFrame:
    """F-A: three spans per document, as one ``spans`` array (row-local, no shuffle).

    Span j starts at word ``(doc_id*7 + j*11) % n_words`` and covers
    ``1 + (doc_id+j) % 3`` words (clipped at the end); label
    ``ENTITY_TYPES[(doc_id+j) % 14]``.  Documents without words get no spans.
    """
    w = whitespace_words("text")
    types = F.array(*[F.lit(t) for t in ENTITY_TYPES])

    def one(j):
        jl = j.cast("long")
        first = ((F.col("doc_id") * 7 + jl * 11) % F.size("_w")).cast("int")
        n = (1 + (F.col("doc_id") + jl) % 3).cast("int")
        span_text = F.array_join(F.slice("_w", first + 1, n), " ")
        label = F.element_at(types, ((F.col("doc_id") + jl) % len(ENTITY_TYPES)).cast("int") + 1)
        return F.struct(
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
            span_text.alias("text"),
            label.alias("label"),
        )

    spans = F.when(F.size("_w") > 0, F.array(*[one(F.lit(j)) for j in range(SPANS_PER_DOC)])
                   ).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,label:string>>"))
    return docs.withColumn("_w", w).select("doc_id", "text", spans.alias("spans"))


def annotated(spark: SparkSession, sf_dir: str, partitioned: bool = True) -> DataFrame:
    """documents -> span documents (doc_id, text, spans).

    With ``partitioned`` the documents are hash-partitioned on doc_id first
    (``align.by_doc``), so spans and tokens derive from one shared exchange.
    """
    from tagflow.operators.align import by_doc
    docs = documents(spark, sf_dir)
    return span_docs(by_doc(docs) if partitioned else docs)


UNKNOWN_LABEL = "NOT_A_LABEL"


def raw_annotation_json(span_docs_df: DataFrame, ids: str = "number") -> DataFrame:
    """F-C: F-A spans nested as raw annotation records, serialised with ``to_json``.

    Spans are split over two annotation entries (first two, then the rest), so
    flattening must walk annotations then results.  Documents whose id is a
    multiple of 17 carry no spans; for multiples of 29 span 0 gets an unknown
    label (quarantine case).  ``ids``: whether records carry a "number", a "text" or "none" as their id.
    """
    doc_id = F.col("doc_id")

    def value(s, i):
        lab = F.when((doc_id % 29 == 0) & (i == 0), F.lit(UNKNOWN_LABEL)).otherwise(s["label"])
        return F.struct(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
                                 F.array(lab).alias("labels")).alias("value"))

    res = F.transform("spans", value)
    empty = F.array().cast("array<struct<value:struct<start:int,end:int,text:string,labels:array<string>>>>")
    res = F.when(doc_id % 17 == 0, empty).otherwise(res)
    annotations = F.array(F.struct(F.slice(res, 1, 2).alias("result")),
                          F.struct(F.slice(res, F.lit(3), F.size(res)).alias("result")))
    own_id = {"none": [], "number": [doc_id.alias("id")], "text": [F.concat(F.lit("doc-"), doc_id).alias("id")]}[ids]
    rec = F.struct(*own_id, F.struct(F.col("text").alias("text")).alias("data"),
                   annotations.alias("annotations"))
    return span_docs_df.select("doc_id", F.to_json(rec).alias("json"))


def annotation_files(spark: SparkSession, sf_dir: str, ids: str = "none") -> str:
    """F-C as JSON-lines files in document order below the shared folder (so the record's number is the document's rank)."""
    path = scratch(spark, "annotations")
    raw = raw_annotation_json(annotated(spark, sf_dir, partitioned=False), ids)
    raw.orderBy("doc_id").select("json").write.text(path)
    return path


FILE_BYTES = 64 << 20  # text of the documents in one file of an array


def annotation_arrays(spark: SparkSession, sf_dir: str, files: int | None = None, file_bytes: int = FILE_BYTES) -> str:
    """F-C as files of one JSON array each, documents in order over the files.  An array is written by one task, so there are as many files as keep
    each at about ``file_bytes`` of text, at least four; their bounds are quantiles of the ids that there are."""
    docs = annotated(spark, sf_dir, partitioned=False)
    raw = raw_annotation_json(docs, "none")
    if files is None:
        held = documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(4, -(-held // file_bytes))
    cuts = documents(spark, sf_dir).agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 100 * files)).first()[0] if files > 1 else None
    bounds = F.array(*[F.lit(int(c)) for c in cuts or []]).cast("array<long>")
    part = F.lpad(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))).cast("string"), 8, "0")  # names sort as numbers
    w = Window.partitionBy("part").orderBy("doc_id")
    head = F.when(F.row_number().over(w) == 1, "[").otherwise(",")
    tail = F.when(F.lead("doc_id").over(w).isNull(), "\n]").otherwise("")
    path = scratch(spark, "annotation-arrays")
    lines = raw.withColumn("part", part).select("part", "doc_id", F.concat(head, F.lit("\n  "), "json", tail).alias("value"))
    lines.repartition(files, "part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


SECTIONS = [("train", "judgement"), ("train", "preamble"), ("dev", "judgement"), ("dev", "preamble")]


def section_of(lang: F.Column) -> F.Column:
    return F.when(lang == "en", F.lit("judgement")).otherwise(F.lit("preamble"))


def by_section(spark: SparkSession, sf_dir: str, name: str, made) -> dict[tuple[str, str], str]:
    """Writes ``made(documents of a section)``, sorted by doc_id, to a folder for each of the four sections; returns their paths."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", split_of(F.col("doc_id")).alias("split"), section_of(F.col("lang")).alias("section"))
    paths = {}
    for split, section in SECTIONS:
        paths[split, section] = scratch(spark, f"{name}-{split}-{section}")
        part = docs.where((F.col("split") == split) & (F.col("section") == section)).select("doc_id", "text")
        made(span_docs(part), paths[split, section])
    return paths


def annotation_sections(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], str]:
    """F-C as four sets of JSON-lines files, records without ids."""
    return by_section(spark, sf_dir, "section", lambda df, path: raw_annotation_json(df, "none").orderBy("doc_id").select("json").write.text(path))


def legacy_sections(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], str]:
    """F-A as four sets of legacy CSV files, each with its own index from 0 in every file."""
    def write(df, path):
        cells = legacy_cells(df).orderBy("doc_id").select((F.monotonically_increasing_id() % (1 << 33)).alias("_c0"), "overall_text", "start", "end", "text", "label")
        cells.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return by_section(spark, sf_dir, "legacy", write)


def legacy_cells(span_docs_df: DataFrame) -> DataFrame:
    """Legacy CSV form: list literals per column (JSON arrays are valid list literals)."""
    def lit_list(field, as_str=False):
        arr = F.transform("spans", lambda s: s[field])
        if as_str:
            return F.to_json(arr)  # JSON strings are valid Python string literals
        items = F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("None")))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return span_docs_df.select("doc_id", F.col("text").alias("overall_text"),
                               lit_list("start").alias("start"), lit_list("end").alias("end"),
                               lit_list("text", True).alias("text"), lit_list("label", True).alias("label"))


def pseudo_predictions(bio_df: DataFrame, true_col: str = "tag_id") -> DataFrame:
    """F-B: deterministic pseudo-predictions next to the true ids.

    pred = (true+1) % 29 where (doc_id*31+pos) % 7 = 0, else 0 where
    (doc_id+pos) % 13 = 0, else the true id.
    """
    d, p, t = F.col("doc_id"), F.col("pos"), F.col(true_col)
    pred = (F.when((d * 31 + p) % 7 == 0, (t + 1) % 29)
            .when((d + p) % 13 == 0, F.lit(0))
            .otherwise(t)).cast("int")
    return bio_df.select("doc_id", "pos", t.cast("int").alias("true_id"), pred.alias("pred_id"))

"""Annotation files that are one JSON array, read in any number of splits.

A file is cut at its closing braces, which Spark's text reader can do from any byte on.  A cut piece doesn't know whether it lies inside a
string or how deep it is nested, so it says both: how many quotes it holds that no backslash covers, and by how much its brackets change
the depth if it begins outside a string and if it begins inside.  Running sums over the pieces in file order give each its state;
a record ends with the piece whose closing brace leads back to depth one.  The pieces of a record are put together and parsed.

The largest unit in memory is one record.  A file must be one well-formed array; state never crosses to the next file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.operators.ids import FILE_ORDER, dense_index, dense_index_with_sums, file_order
from tagflow.operators.spans import span_extract
from tagflow.schema import RAW_ANNOTATION


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(json, first): the text of each object of the arrays at ``path``, and the number of its first piece (sorting by it gives file order)."""
    pieces = file_order(spark.read.option("lineSep", "}").text(path).select("value", "_metadata"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(bare, '"', -1)
    side = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    held = lambda s, marks: F.length(s) - F.length(F.translate(s, marks, ""))
    change = lambda odd: (held(side(odd), "{[") - held(side(odd), "]")).cast("long")
    told = pieces.select("value", *FILE_ORDER, (F.size(parts) - 1).cast("long").alias("quotes"), change(0).alias("outside"), change(1).alias("inside"))
    told = dense_index_with_sums(told, FILE_ORDER, "idx", 0, {"quoted": F.col("quotes")})

    def since_file(df, total, own):
        """Running sum within the file, the row's own part left out."""
        start = df.groupBy("_file").agg(F.min_by(F.col(total) - F.col(own), "idx").alias("_start"))  # one row per file
        return df.join(start, "_file").withColumn("_before", F.col(total) - F.col(own) - F.col("_start")).drop("_start")

    state = since_file(told, "quoted", "quotes")
    opened = F.col("_before") % 2 == 1
    closed = (F.col("_before") + F.col("quotes")) % 2 == 0  # the brace behind the piece stands outside a string
    light = state.select("idx", "_file", closed.alias("closed"), (F.when(opened, F.col("inside")).otherwise(F.col("outside")) - closed.cast("long")).alias("change"))
    deep = since_file(dense_index_with_sums(light, ["idx"], "_i", 0, {"depth": F.col("change")}), "depth", "change")
    ends = deep.select("idx", "_file", (F.col("closed") & (F.col("_before") + F.col("change") == 1)).cast("long").alias("ends"))
    numbered = dense_index_with_sums(ends, ["idx"], "_i", 0, {"record": F.col("ends")}).select("idx", "_file", (F.col("record") - F.col("ends")).alias("record"))
    whole = told.select("idx", "value").join(numbered, "idx").groupBy("_file", "record").agg(
        F.min("idx").alias("first"), F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda x: x["value"]), "}"), F.lit("}"))
    return whole.select(F.regexp_replace(text, r"^[\s,\[\x{FEFF}]+", "").alias("json"), "first").where(F.col("json").startswith("{"))


def read_annotation_arrays(spark: SparkSession, path: str | list[str], split: str | None = None, section: str | None = None) -> DataFrame:
    """Files of one JSON array each -> span documents, as ``annotations.read_annotations`` with ``multi_line`` gives them, but splittable."""
    raw = array_records(spark, path).select("first", F.from_json("json", RAW_ANNOTATION).alias("r")).select("first", "r.*")
    out = span_extract(dense_index(raw.withColumnRenamed("id", "source_id"), ["first"], "doc_id"), keep=["source_id"])
    for name, value in (("split", split), ("section", section)):
        out = out.withColumn(name, F.lit(value)) if value is not None else out
    return out

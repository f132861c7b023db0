"""Token-level metrics as aggregations (E1-E7) and per-token arg-max (M8).

Every metric is one pass: a map-side partial aggregate per partition and a
tiny final merge (at most one row per label), so it scales with the token
table without shuffling it.  ``by`` gives per-group figures (e.g. per batch).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagflow.schema import OUTSIDE_ID, PAD_ID

def _nan():
    return F.lit(float("nan"))


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def prf_micro(df: DataFrame, true: str = "true_id", pred: str = "pred_id", outside_id: int = OUTSIDE_ID,
              by: list[str] | None = None, exclude_ids: Iterable[int] = ()) -> DataFrame:
    """Micro precision/recall over non-outside tokens, F1 = 2PR/(P+R).

    A zero denominator counts as 1 (precision/recall 0); F1 is NaN when P+R = 0.
    ``exclude_ids``: tokens with such a true id are left out (none by default, as in the reference; {29} leaves pads out).
    """
    t, p = F.col(true), F.col(pred)
    out = list(exclude_ids)
    src = df.where(~t.isin(out)) if out else df
    agg = (src.groupBy(*(by or []))
           .agg(F.count_if((p == t) & (p != outside_id)).alias("tp"),
                F.count_if(p != outside_id).alias("n_pred"),
                F.count_if(t != outside_id).alias("n_true")))
    prec = _ratio(F.col("tp"), F.greatest(F.col("n_pred"), F.lit(1)))
    rec = _ratio(F.col("tp"), F.greatest(F.col("n_true"), F.lit(1)))
    f1 = F.when(prec + rec == 0, _nan()).otherwise(2 * prec * rec / (prec + rec))
    return agg.select(*(by or []), "tp", "n_pred", "n_true", prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"))


def label_counts(df: DataFrame, true: str = "true_id", pred: str = "pred_id", pad_id: int | None = PAD_ID,
                 by: list[str] | None = None) -> DataFrame:
    """Per label: tp, n_pred, n_true over rows whose true label is not the pad."""
    src = df if pad_id is None else df.where(F.col(true) != pad_id)
    t, p = F.col(true), F.col(pred)
    both = F.array(F.struct(t.alias("label"), F.lit(1).alias("is_true"), (p == t).cast("int").alias("hit"),
                            F.lit(0).alias("is_pred")),
                   F.struct(p.alias("label"), F.lit(0).alias("is_true"), F.lit(0).alias("hit"),
                            F.lit(1).alias("is_pred")))
    ex = src.select(*(by or []), F.inline(both))
    return (ex.groupBy(*(by or []), "label")
            .agg(F.sum("hit").alias("tp"), F.sum("is_pred").alias("n_pred"), F.sum("is_true").alias("n_true")))


def f1_weighted(df: DataFrame, true: str = "true_id", pred: str = "pred_id", labels: Iterable[int] | None = None,
                pad_id: int | None = PAD_ID, by: list[str] | None = None) -> DataFrame:
    """Support-weighted mean of per-label F1 over rows with true != pad.

    Labels are those seen in true or pred, or ``labels`` when given; the label
    filter is applied *after* counting, so confusions with other labels still
    count.  Per-label F1 = 2 tp / (n_pred + n_true) (0 when undefined).
    """
    c = label_counts(df, true, pred, pad_id, by)
    if labels is not None:
        c = c.where(F.col("label").isin(list(labels)))
    f1_l = F.when(F.col("n_pred") + F.col("n_true") == 0, F.lit(0.0)).otherwise(
        _ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_true")))
    agg = c.groupBy(*(by or [])).agg(F.sum(f1_l * F.col("n_true")).alias("_num"),
                                     F.sum("n_true").alias("support"))
    return agg.select(*(by or []), F.coalesce(F.col("support"), F.lit(0)).cast("long").alias("support"),
                      F.when(F.coalesce(F.col("support"), F.lit(0)) == 0, F.lit(0.0))
                      .otherwise(F.col("_num") / F.col("support")).alias("f1_weighted"))


def token_accuracy(df: DataFrame, true: str = "true_id", pred: str = "pred_id", pad_id: int | None = PAD_ID,
                   by: list[str] | None = None) -> DataFrame:
    """E6 (pads removed, default) / E7 (``pad_id=None``: all positions)."""
    src = df if pad_id is None else df.where(F.col(true) != pad_id)
    return src.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(true) == F.col(pred)).alias("n_equal"),
        _ratio(F.count_if(F.col(true) == F.col(pred)), F.count(F.lit(1))).alias("accuracy"))


def token_accuracy_padded(df: DataFrame, true: str = "true_id", pred: str = "pred_id", key: str = "doc_id",
                          order: str = "pos") -> DataFrame:
    """E7 on the matrix padded to the longest sequence, from counts alone: pads = sequences x maximum - tokens, all right."""
    per = df.groupBy(key).agg((F.max(order) + 1).cast("long").alias("_n"), F.count(F.lit(1)).alias("_t"),
                              F.count_if(F.col(true) == F.col(pred)).alias("_e"))
    total = per.agg((F.count(F.lit(1)) * F.max("_n")).alias("n"), F.sum("_t").alias("t"), F.sum("_e").alias("e"))
    equal = F.col("n") - F.col("t") + F.col("e")
    return total.select("n", equal.alias("n_equal"), _ratio(equal, F.col("n")).alias("accuracy"))


def argmax(probs: Column | str) -> Column:
    """M8: index of the largest value of an array (first index on ties), 0-based."""
    c = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")

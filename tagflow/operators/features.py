"""Contextual token features (F1-F4) as window expressions.

Windows are partitioned by document and ordered by position; on a
doc-partitioned token table they add no exchange.  A window partition is one
document, bounded by the token cap, and spills if needed.  The templates here run
from the last token back, so the last tag is the window's first value, known at
every row without going over the document again; all of them share one sort.  Templates are
plain ``Column`` builders, so users add features without a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNK_CONTEXT = "<unk>"  # border word (lower-case, unlike the <UNK> feature key)


def doc_window(key: str = "doc_id", order: str = "pos"):
    return Window.partitionBy(key).orderBy(order)


def back_window(key: str = "doc_id", order: str = "pos"):
    """A document from its last token back: ``lead`` gives the token before, ``lag`` the one behind."""
    return Window.partitionBy(key).orderBy(F.col(order).desc())


@dataclass(frozen=True)
class FeatureTemplate:
    name: str
    build: Callable[[str, str], Column]  # (key, order) -> string Column
    near: bool = True  # looks at other tokens; what doesn't is made behind the windows and not carried through their sort


def _word(key, order):
    return F.concat(F.lit("word="), F.col("tok"))


def _prev_word(key, order):
    return F.concat(F.lit("prev_word="), F.lead("tok", 1, UNK_CONTEXT).over(back_window(key, order)))


def _next_word(key, order):
    return F.concat(F.lit("next_word="), F.lag("tok", 1, UNK_CONTEXT).over(back_window(key, order)))


def _pos(key, order):
    return F.concat(F.lit("pos="), F.col("pos_tag"))


def _prev_pos(key, order, boundary: str = "reference"):
    w = back_window(key, order)
    inner = F.concat(F.lit("prev_pos="), F.lead("pos_tag", 1).over(w))
    if boundary == "clean":
        return F.coalesce(inner, F.lit("prev_pos=" + UNK_CONTEXT))
    # reference border: the first token sees the tag of the LAST token, with a doubled prefix
    last = F.first("pos_tag").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.coalesce(inner, F.concat(F.lit("prev_pos=pos="), last))


def _next_pos(key, order, boundary: str = "reference"):
    w = back_window(key, order)
    inner = F.concat(F.lit("next_pos="), F.lag("pos_tag", 1).over(w))
    if boundary == "clean":
        return F.coalesce(inner, F.lit("next_pos=" + UNK_CONTEXT))
    # reference border: the last token repeats its own tag, with a doubled prefix
    return F.coalesce(inner, F.concat(F.lit("next_pos=pos="), F.col("pos_tag")))


WORD_TEMPLATES = [FeatureTemplate("f_word", _word, near=False), FeatureTemplate("f_prev_word", _prev_word),
                  FeatureTemplate("f_next_word", _next_word)]


def pos_templates(boundary: str = "reference") -> list[FeatureTemplate]:
    return [FeatureTemplate("f_pos", _pos, near=False),
            FeatureTemplate("f_prev_pos", lambda k, o: _prev_pos(k, o, boundary)),
            FeatureTemplate("f_next_pos", lambda k, o: _next_pos(k, o, boundary))]


def default_templates(boundary: str = "reference") -> list[FeatureTemplate]:
    """F4 slot order: word, prev_word, next_word, pos, prev_pos, next_pos."""
    return WORD_TEMPLATES + pos_templates(boundary)


def context_features(tokens: DataFrame, templates: list[FeatureTemplate] | None = None,
                     key: str = "doc_id", order: str = "pos") -> DataFrame:
    """one string column per template next to the token columns."""
    templates = templates if templates is not None else default_templates()
    seen = tokens.select("*", *[t.build(key, order).alias(t.name) for t in templates if t.near])
    return seen.select(*tokens.columns, *[t.name if t.near else t.build(key, order).alias(t.name) for t in templates])


def featurise(tokens: DataFrame, templates: list[FeatureTemplate] | None = None, key: str = "doc_id",
              order: str = "pos", long: bool = True) -> DataFrame:
    """(doc_id, pos, slot, feature) long rows, or (doc_id, pos, feats array) with ``long=False``."""
    templates = templates if templates is not None else default_templates()
    wide = context_features(tokens, templates, key, order)
    arr = F.array(*[F.col(t.name) for t in templates])
    if not long:
        return wide.select(key, order, arr.alias("feats"))
    return wide.select(key, order, F.posexplode(arr).alias("slot", "feature"))


# ---------------------------------------------------------------- POS stand-ins
def shape_tag(tok: Column | str = "tok") -> Column:
    """F-E surrogate part-of-speech tag by token shape: NUM, PUNCT, CAP or LOW.

    A first letter of a-z or A-Z settles the tag by comparing bytes; the other tokens are matched.
    """
    t = F.col(tok) if isinstance(tok, str) else tok
    return (F.when((t >= "a") & (t < "{"), F.lit("LOW"))
            .when((t >= "A") & (t < "["), F.lit("CAP"))
            .when(t.rlike(r"^\p{N}+$"), F.lit("NUM"))
            .when(~t.rlike(r"[\p{L}\p{N}_]"), F.lit("PUNCT"))
            .when(t.rlike(r"^\p{Lu}"), F.lit("CAP"))
            .otherwise(F.lit("LOW")))


def lexicon_pos_fit(tagged: DataFrame, tok: str = "tok", tag: str = "pos_tag") -> DataFrame:
    """F2 fit: most frequent tag per word (ties -> larger tag name): (tok, lex_tag).

    Partial aggregation on (word, tag) first, so a hot word does not move its
    rows through one task.
    """
    counts = tagged.groupBy(tok, tag).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(tok).agg(F.max_by(F.col(tag), F.struct("_c", tag)).alias("lex_tag"))


def lexicon_pos_apply(tokens: DataFrame, lexicon: DataFrame, tok: str = "tok", default: str = "NN",
                      out: str = "pos_tag") -> DataFrame:
    """F2 apply: lexicon tag, or ``default`` for unseen words."""
    return (tokens.join(lexicon, tok, "left")
            .withColumn(out, F.coalesce(F.col("lex_tag"), F.lit(default))).drop("lex_tag"))

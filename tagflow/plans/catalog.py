"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

``ORACLES`` holds the DuckDB text for every query that SQL can express.  Column
names and integer widths are aliased/cast identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.functions import arrays as ar
from tagflow.functions import text as tx
from tagflow.operators import align
from tagflow.operators import batches as ba
from tagflow.operators import coded as cd
from tagflow.operators import crf
from tagflow.operators import crf_blocks
from tagflow.operators import dictionary as dc
from tagflow.operators import features as fe
from tagflow.operators import halos
from tagflow.operators import heads as hd
from tagflow.operators import metrics as me
from tagflow.operators import pad as pd_
from tagflow.operators import relu_head as rh
from tagflow.operators import spans as sp
from tagflow.operators import tagger as tg
from tagflow.operators import training as tr
from tagflow.operators import vocab as vo
from tagflow.operators import wordpiece as wpc
from tagflow.plans import fixtures as fx
from tagflow.plans import oracle as oq
from tagflow.schema import label_to_id
from tagflow.session import scratch, tune
from tagflow.sources import annotations as ann
from tagflow.sources import conll as co
from tagflow.sources import encoded as en
from tagflow.sources import json_array as ja

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


# ---------------------------------------------------------------- alignment
def bio(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    return align.align(fx.annotated(spark, sf_dir), max_len, partitioned=True)


@register("bio_tags", oq.with_(oq.bio_ctes()) + " SELECT * FROM bio")
def q_bio_tags(spark, sf_dir):
    """A1+A2 (flagship): BIO tag per token of the whole text."""
    return bio(spark, sf_dir)


BY_DOC_SQL = """
 SELECT doc_id, count(*) AS n_tokens, md5(string_agg({0}, chr(10) ORDER BY pos)) AS {1} FROM {2} GROUP BY doc_id"""


@register("bio_tags_by_doc", oq.with_(oq.bio_ctes()) + BY_DOC_SQL.format("tok || ' ' || tag", "tags_md5", "bio"))
def q_bio_tags_by_doc(spark, sf_dir):
    """A1+A2: the flagship's rows as one digest per document."""
    return tag_digest(bio(spark, sf_dir))


@register("bio_tags_blocked", oq.with_(oq.bio_ctes()) + BY_DOC_SQL.format("tok || ' ' || tag", "tags_md5", "bio"))
def q_bio_tags_blocked(spark, sf_dir):
    """A1+A2 by blocks of 100 positions with halos of the longest span; a digest per document."""
    return tag_digest(halos.align_blocks(fx.annotated(spark, sf_dir, partitioned=False), block=100))


@register("bio_tags_cut64", oq.with_(oq.bio_ctes(64)) + " SELECT * FROM bio")
def q_bio_tags_cut64(spark, sf_dir):
    """A1+A2 with a 64-token cap: spans past or across the cut are dropped."""
    return bio(spark, sf_dir, 64)


@register("span_locate", oq.with_(oq.fa_spans_ctes(), oq.tokens_ctes(), oq.entity_ctes(), oq.locate_ctes())
          + " SELECT doc_id, j, label, CAST(n AS INT) AS n, s FROM f")
def q_span_locate(spark, sf_dir):
    """A1: first token-level occurrence of every span."""
    docs = fx.annotated(spark, sf_dir)
    toks = align.tokens(docs)
    located = align.locate_spans(toks, align.entity_tokens(align.span_rows(docs)))
    return located.select("doc_id", "j", "label", located.n.cast("int").alias("n"), "s")


# ---------------------------------------------------------------- spans / sources


def fc_span_docs(spark, sf_dir, ids="none"):
    return ann.read_annotations(spark, fx.annotation_files(spark, sf_dir, ids))


#: A record's number in file order, as the files are written in document order.
RANKED = ", r AS (SELECT doc_id AS own, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM documents)"


@register("ann_json_scan", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id, j, text, label FROM fc JOIN r ON fc.doc_id = r.own""")
def q_ann_json_scan(spark, sf_dir):
    """S1+P1+P2: annotation files (JSON lines, records without ids) -> flattened spans in order."""
    return sp.span_rows(fc_span_docs(spark, sf_dir)).select("doc_id", F.col("j").cast("int").alias("j"), "text", "label")


@register("ann_json_array", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id, j, text, label FROM fc JOIN r ON fc.doc_id = r.own""")
def q_ann_json_array(spark, sf_dir):
    """S1+P1+P2: annotation files of one JSON array each, cut at braces and put together by running sums -> flattened spans in order."""
    docs = ja.read_annotation_arrays(spark, fx.annotation_arrays(spark, sf_dir))
    return sp.span_rows(docs).select("doc_id", F.col("j").cast("int").alias("j"), "text", "label")


@register("ann_json_scan_ids", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id, 'doc-' || r.own AS source_id, CAST(count(fc.j) AS INT) AS n_spans FROM r LEFT JOIN fc ON fc.doc_id = r.own
 GROUP BY r.doc_id, r.own""")
def q_ann_json_scan_ids(spark, sf_dir):
    """Annotation files whose records have text ids; the id is carried, the number is the key."""
    return fc_span_docs(spark, sf_dir, "text").select("doc_id", "source_id", F.size("spans").cast("int").alias("n_spans"))


@register("span_extract", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id, d.text, coalesce(s.labels, '') AS labels, coalesce(s.texts, '') AS texts
 FROM r JOIN documents d ON d.doc_id = r.own
 LEFT JOIN (SELECT doc_id, string_agg(label, ' ' ORDER BY j) AS labels, string_agg(text, '|' ORDER BY j) AS texts FROM fc GROUP BY doc_id) s
   ON s.doc_id = r.own""")
def q_span_extract(spark, sf_dir):
    """Document text of each record, with its spans' labels and texts in order."""
    return fc_span_docs(spark, sf_dir).select("doc_id", "text", F.array_join("spans.label", " ").alias("labels"),
                                              F.array_join("spans.text", "|").alias("texts"))


@register("span_offsets", """
 WITH p AS (SELECT doc_id, instr(text, ' ') AS b FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, 0 AS j, CAST(0 AS INT) AS "start", CAST(b AS INT) AS "end" FROM p WHERE b > 0 AND doc_id % 17 <> 0""")
def q_span_offsets(spark, sf_dir):
    """Start and end of a span that covers a text up to its first blank, through the annotation files."""
    docs = fx.documents(spark, sf_dir).where(F.col("text").isNotNull())
    b = F.instr("text", " ")
    span = F.struct(F.lit(0).alias("start"), b.alias("end"), F.substring("text", F.lit(1), b).alias("text"), F.lit("ORG").alias("label"))
    none = F.array().cast("array<struct<start:int,end:int,text:string,label:string>>")
    raw = fx.raw_annotation_json(docs.select("doc_id", "text", F.when(b > 0, F.array(span)).otherwise(none).alias("spans")), "number")
    out = raw.select("doc_id", ann.parse_annotations(raw.json).alias("r")).select("doc_id", "r.data", "r.annotations")
    kept = sp.span_rows(sp.span_extract(out)).select("doc_id", F.col("j").cast("int").alias("j"), "start", "end")
    return kept


@register("span_docs", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id, CAST(count(fc.j) AS INT) AS n_spans FROM r LEFT JOIN fc ON r.own = fc.doc_id
 GROUP BY r.doc_id""")
def q_span_docs(spark, sf_dir):
    """One row per document, documents without spans kept."""
    return sp.span_counts(fc_span_docs(spark, sf_dir))


@register("invalid_label_docs", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT DISTINCT r.doc_id FROM fc JOIN r ON fc.doc_id = r.own WHERE label NOT IN (SELECT unnest(""" + oq.LAB + """)) OR label IS NULL""")
def q_invalid_label_docs(spark, sf_dir):
    """Documents holding a label outside the dictionary."""
    return sp.invalid_label_docs(fc_span_docs(spark, sf_dir))


@register("valid_label_docs", oq.with_(oq.fc_spans_ctes()) + RANKED + """
 SELECT r.doc_id FROM r WHERE r.own NOT IN (SELECT doc_id FROM fc WHERE label NOT IN (SELECT unnest(""" + oq.LAB + """)) OR label IS NULL)""")
def q_valid_label_docs(spark, sf_dir):
    """Documents left when those with a label outside the dictionary are dropped."""
    return sp.drop_invalid_label_docs(fc_span_docs(spark, sf_dir)).select("doc_id")


@register("section_union", """
 SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split,
        CASE WHEN lang = 'en' THEN 'judgement' ELSE 'preamble' END AS section FROM documents""")
def q_section_union(spark, sf_dir):
    """P5: judgement and preamble parts concatenated by column name."""
    d = fx.read_table(spark, sf_dir, "documents").select("doc_id", "lang", fx.split_of(F.col("doc_id")).alias("split"))
    parts = {"judgement": d.where(F.col("lang") == "en"), "preamble": d.where((F.col("lang") != "en") | F.col("lang").isNull())}
    return sp.section_union(parts, ids="keep").select("doc_id", "split", "section")


def tag_digest(tagged, *more):
    """One row per document: tokens, and the MD5 of its ``tok tag`` lines in order."""
    return tagged.groupBy(*more, "doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), lines_md5(F.concat_ws(" ", "tok", "tag")).alias("tags_md5"))


def lines_md5(line):
    """MD5 of a group's lines in order of position; lines are made before they are collected, and sorted as rows without a comparing lambda."""
    return F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n"))


@register("section_bio_tags", oq.with_(oq.section_ctes()) + """
 SELECT split, section, n AS doc_id, doc_id AS part_id, n_tokens, tags_md5 FROM (
  SELECT num.split, num.section, num.n, num.part_id AS doc_id, count(*) AS n_tokens, md5(string_agg(bio.tok || ' ' || bio.tag, chr(10) ORDER BY pos)) AS tags_md5
  FROM bio JOIN num USING (doc_id) GROUP BY ALL)""")
def q_section_bio_tags(spark, sf_dir):
    """S1+P4+P5+A2: four annotation file sets {train, dev} x {judgement, preamble} written, read, united, cleaned and aligned; a digest per document."""
    united = ann.read_sections(spark, fx.annotation_sections(spark, sf_dir))
    tags = align.align(sp.drop_invalid_label_docs(united).select("doc_id", "text", "spans"))
    return united.select("split", "section", "doc_id", "part_id").join(tag_digest(tags), "doc_id").select("split", "section", "doc_id", "part_id", "n_tokens", "tags_md5")


@register("legacy_sections", oq.with_(oq.fa_spans_ctes(), oq.section_numbers()) + """
 SELECT num.split, num.section, num.n AS doc_id, j, text, label FROM spans JOIN num USING (doc_id)""")
def q_legacy_sections(spark, sf_dir):
    """S3+P5: four sets of legacy CSV files whose indexes all start at 0, read and united; the spans of each document."""
    paths = fx.legacy_sections(spark, sf_dir)
    united = sp.section_union({k: ann.read_legacy_spans(spark, p) for k, p in paths.items()})
    return sp.span_rows(united).join(united.select("doc_id", "split", "section"), "doc_id").select(
        "split", "section", "doc_id", F.col("j").cast("int").alias("j"), "text", "label")


@register("legacy_list_parse", oq.with_(oq.fa_spans_ctes()) + " SELECT doc_id, j, text, label FROM spans")
def q_legacy_list_parse(spark, sf_dir):
    """S3 legacy: list-literal cells parsed back into span arrays (Arrow-batched pandas UDF)."""
    cells = fx.legacy_cells(fx.annotated(spark, sf_dir, partitioned=False))
    return sp.span_rows(ann.legacy_to_span_docs(cells)).select("doc_id", F.col("j").cast("int").alias("j"), "text", "label")


@register("normalise_text", "SELECT doc_id, " + tx.DUCK_NORMALISE.format(x="text") + " AS norm_text FROM documents")
def q_normalise_text(spark, sf_dir):
    """Space after each listed mark, runs of spaces collapsed."""
    return fx.documents(spark, sf_dir).select("doc_id", tx.normalise("text").alias("norm_text"))


@register("word_tokens", oq.with_(oq.tokens_ctes(None)) + " SELECT doc_id, pos, tok FROM t")
def q_word_tokens(spark, sf_dir):
    """Uncut word/punctuation tokens of every document."""
    return align.tokens(fx.documents(spark, sf_dir), None).select("doc_id", F.col("pos").cast("int").alias("pos"), "tok")


@register("entity_tokens", oq.with_(oq.fa_spans_ctes(), oq.entity_ctes())
          + " SELECT doc_id, j, CAST(n AS INT) AS n, CAST(k AS INT) AS k, tok FROM e")
def q_entity_tokens(spark, sf_dir):
    """Tokens of every entity span."""
    e = align.entity_tokens(align.span_rows(fx.annotated(spark, sf_dir, partitioned=False)))
    return e.select("doc_id", F.col("j").cast("int").alias("j"), F.col("n").cast("int").alias("n"),
                    F.col("k").cast("int").alias("k"), "tok")


# ---------------------------------------------------------------- metrics


def fb(spark, sf_dir, max_len=None):
    return fx.pseudo_predictions(bio(spark, sf_dir, max_len))


def r9(c):
    return F.round(F.col(c), 9).alias(c)


@register("prf_micro", oq.with_(oq.fb_ctes()) + """
 SELECT tp, n_pred, n_true, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (
  SELECT tp, n_pred, n_true, tp / greatest(n_pred, 1) AS precision, tp / greatest(n_true, 1) AS recall,
         CASE WHEN tp / greatest(n_pred, 1) + tp / greatest(n_true, 1) = 0 THEN 'NaN'::DOUBLE
              ELSE 2 * (tp / greatest(n_pred, 1)) * (tp / greatest(n_true, 1))
                   / (tp / greatest(n_pred, 1) + tp / greatest(n_true, 1)) END AS f1
  FROM (SELECT count(*) FILTER (WHERE pred_id = true_id AND pred_id <> 0) AS tp,
               count(*) FILTER (WHERE pred_id <> 0) AS n_pred,
               count(*) FILTER (WHERE true_id <> 0) AS n_true FROM pred))""")
def q_prf_micro(spark, sf_dir):
    """Micro precision, recall, F1 outside label 0."""
    m = me.prf_micro(fb(spark, sf_dir))
    return m.select("tp", "n_pred", "n_true", r9("precision"), r9("recall"), r9("f1"))


@register("prf_micro_excluding", oq.with_(oq.fb_ctes()) + """
 SELECT count(*) FILTER (WHERE pred_id = true_id AND pred_id <> 0) AS tp, count(*) FILTER (WHERE pred_id <> 0) AS n_pred,
        count(*) FILTER (WHERE true_id <> 0) AS n_true FROM pred WHERE true_id NOT IN (6, 20)""")
def q_prf_micro_excluding(spark, sf_dir):
    """E1-E3 with tokens of given true labels left out (here B-DATE and I-DATE)."""
    return me.prf_micro(fb(spark, sf_dir), exclude_ids=[6, 20]).select("tp", "n_pred", "n_true")


def _f1w_sql(label_filter: str, src: str = "pred") -> str:
    return f"""
 , cnt AS (SELECT label, sum(hit) AS tp, sum(is_pred) AS n_pred, sum(is_true) AS n_true FROM (
      SELECT true_id AS label, 1 AS is_true, CAST(pred_id = true_id AS INT) AS hit, 0 AS is_pred FROM {src} WHERE true_id <> 29
      UNION ALL SELECT pred_id, 0, 0, 1 FROM {src} WHERE true_id <> 29) GROUP BY label)
 SELECT CAST(coalesce(sum(n_true), 0) AS BIGINT) AS support,
        round(CASE WHEN coalesce(sum(n_true), 0) = 0 THEN 0.0
              ELSE sum(CASE WHEN n_pred + n_true = 0 THEN 0.0 ELSE 2.0 * tp / (n_pred + n_true) END * n_true)
                   / sum(n_true) END, 9) AS f1_weighted
 FROM cnt {label_filter}"""


@register("f1_weighted", oq.with_(oq.fb_ctes()) + _f1w_sql(""))
def q_f1_weighted(spark, sf_dir):
    """Support-weighted F1 over all labels seen, pads removed."""
    return me.f1_weighted(fb(spark, sf_dir)).select("support", r9("f1_weighted"))


@register("f1_weighted_entities", oq.with_(oq.fb_ctes()) + _f1w_sql("WHERE label BETWEEN 1 AND 27"))
def q_f1_weighted_entities(spark, sf_dir):
    """E5: weighted F1 restricted to label ids 1..27 after counting."""
    return me.f1_weighted(fb(spark, sf_dir), labels=range(1, 28)).select("support", r9("f1_weighted"))


@register("f1_weighted_cut64", oq.with_(oq.fb_ctes(64)) + _f1w_sql(""))
def q_f1_weighted_cut64(spark, sf_dir):
    """E4 on the 64-token cut."""
    return me.f1_weighted(fb(spark, sf_dir, 64)).select("support", r9("f1_weighted"))


@register("token_accuracy", oq.with_(oq.fb_ctes()) + """
 SELECT count(*) AS n, count(*) FILTER (WHERE true_id = pred_id) AS n_equal,
        round(count(*) FILTER (WHERE true_id = pred_id) / count(*), 9) AS accuracy FROM pred WHERE true_id <> 29""")
def q_token_accuracy(spark, sf_dir):
    """Accuracy with pad positions removed (the long table has none)."""
    a = me.token_accuracy(fb(spark, sf_dir))
    return a.select("n", "n_equal", r9("accuracy"))


@register("token_accuracy_all", oq.with_(oq.fb_ctes()) + """,
 lens AS (SELECT doc_id, max(pos) + 1 AS n FROM pred GROUP BY doc_id),
 pads AS (SELECT sum((SELECT max(n) FROM lens) - n) AS p FROM lens),
 hits AS (SELECT count(*) AS n, count(*) FILTER (WHERE true_id = pred_id) AS e FROM pred)
 SELECT CAST(n + p AS BIGINT) AS n, CAST(e + p AS BIGINT) AS n_equal, round((e + p) / (n + p), 9) AS accuracy FROM hits, pads""")
def q_token_accuracy_all(spark, sf_dir):
    """Accuracy over every position of the matrix padded to the corpus maximum (pads are predicted as pads)."""
    a = me.token_accuracy_padded(fb(spark, sf_dir))
    return a.select("n", "n_equal", r9("accuracy"))


@register("argmax_label", """
 SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS pred, label FROM embeddings""")
def q_argmax_label(spark, sf_dir):
    """M8: per-row arg-max of a score vector (first index on ties)."""
    e = fx.read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", me.argmax("embedding").alias("pred"), "label")


# ---------------------------------------------------------------- vocabulary / features


def tagged_tokens(spark, sf_dir):
    """Doc-partitioned BIO tokens with the F-E shape tag and the split."""
    b = bio(spark, sf_dir)
    return b.select("doc_id", "pos", "tok", "tag", "tag_id", fe.shape_tag("tok").alias("pos_tag"),
                    fx.split_of(F.col("doc_id")).alias("split"))


FEATURES = [t.name for t in fe.default_templates()]


def coded_tokens(spark, sf_dir):
    """Tokens with their six features, coded by chunks and written once (doc_id, split, tag_id, features): dictionary, encoding and CRF read it."""
    wide = fe.context_features(tagged_tokens(spark, sf_dir))
    return cd.code(wide, FEATURES, ["split"], ["tag_id"], fit=F.col("split") == "train")


def features_long(wide):
    return wide.select("doc_id", "pos", "split", F.posexplode(F.array(*FEATURES)).alias("slot", "feature"))


def train_features(spark, sf_dir):
    """Training tokens with their six features; a window holds one document, so the other split's tokens needn't pass through the windows."""
    return fe.context_features(tagged_tokens(spark, sf_dir).where(F.col("split") == "train"))


def feature_dictionary(wide):
    """The dictionary of the features of ``wide``, which holds training tokens only."""
    return vo.feature_dict(vo.feature_set(features_long(wide)))


def encoded(spark, sf_dir):
    """Coded tokens whose features are ids, and the feature dictionary (fitted on the training tokens)."""
    coded = coded_tokens(spark, sf_dir)
    fd = vo.feature_dict(vo.feature_set(cd.features(coded)))
    return vo.feature_encode_coded(coded, fd), fd


def encoded_tokens(spark, sf_dir):
    """(doc_id, pos, split, tag_id, fids array of six ids) and the feature dictionary."""
    coded, fd = encoded(spark, sf_dir)
    return cd.token_rows(coded), fd


@register("word_vocab", oq.with_(oq.features_ctes()) + oq.vocab_sql())
def q_word_vocab(spark, sf_dir):
    """V1: word vocabulary over train+dev, <UNK>=0, <PAD>=1, sorted ids from 2."""
    return vo.word_vocab(tagged_tokens(spark, sf_dir))


@register("word_vocab_grown", oq.with_(oq.features_ctes()) + """,
 own AS (SELECT tok, min(CASE split WHEN 'train' THEN 0 ELSE 1 END) AS late FROM tt WHERE tok NOT IN ('<UNK>', '<PAD>') GROUP BY tok)
 SELECT tok AS word, row_number() OVER (ORDER BY late, tok) + 1 AS word_id, CAST(late + 1 AS INT) AS version FROM own
 UNION ALL SELECT '<UNK>', 0, 0 UNION ALL SELECT '<PAD>', 1, 0""")
def q_word_vocab_grown(spark, sf_dir):
    """V1 by increments: the words of train, then those that only dev has, with the next ids; compacted in between."""
    tt = tagged_tokens(spark, sf_dir).select("split", "tok")
    d = dc.GrowingDictionary.create(spark, scratch(spark, "grown"), {vo.UNK_WORD: 0, vo.PAD_WORD: 1})
    d.add(tt.where(F.col("split") == "train"), "tok")
    d.compact()
    d.add(tt.where(F.col("split") == "dev"), "tok")
    return d._rows(d.version).select(F.col("key").alias("word"), F.col("id").alias("word_id"), "version")


@register("word_encode", oq.with_(oq.features_ctes()) + ", v AS (" + oq.vocab_sql() + """)
 SELECT tt.doc_id, tt.pos, coalesce(v.word_id, 0) AS word_id FROM tt LEFT JOIN v ON tt.tok = v.word""")
def q_word_encode(spark, sf_dir):
    """V2: words -> ids with the vocabulary of train and dev."""
    tt = tagged_tokens(spark, sf_dir)
    return vo.word_encode(tt, vo.word_vocab(tt)).select("doc_id", "pos", "word_id")


@register("word_encode_train", oq.with_(oq.features_ctes()) + ", v AS (" + oq.vocab_sql("AND split = 'train'") + """)
 SELECT tt.doc_id, tt.pos, coalesce(v.word_id, 0) AS word_id FROM tt LEFT JOIN v ON tt.tok = v.word""")
def q_word_encode_train(spark, sf_dir):
    """V2: words -> ids with a vocabulary fitted on train only (dev-only words -> <UNK>)."""
    tt = tagged_tokens(spark, sf_dir)
    return vo.word_encode(tt, vo.word_vocab(tt, fit_on=("train",))).select("doc_id", "pos", "word_id")


@register("feature_set", oq.with_(oq.features_ctes()) + " SELECT DISTINCT feature FROM fl WHERE split = 'train'")
def q_feature_set(spark, sf_dir):
    """V3: distinct features of the training split."""
    return vo.feature_set(features_long(train_features(spark, sf_dir)))


@register("feature_dict", oq.with_(oq.features_ctes()) + " SELECT feature, feature_id FROM fdict")
def q_feature_dict(spark, sf_dir):
    """V4: feature dictionary, <PAD>=0, <UNK>=1."""
    return feature_dictionary(train_features(spark, sf_dir))


@register("feature_encode", oq.with_(oq.features_ctes()) + """
 SELECT doc_id, pos, string_agg(CAST(coalesce(d.feature_id, 1) AS VARCHAR), ' ' ORDER BY slot) AS feature_ids
 FROM fl LEFT JOIN fdict d ON fl.feature = d.feature GROUP BY doc_id, pos""")
def q_feature_encode(spark, sf_dir):
    """V5: every token's six features encoded; unseen (dev) features -> <UNK>=1."""
    enc, _ = encoded_tokens(spark, sf_dir)
    return enc.select("doc_id", "pos", F.array_join("fids", " ").alias("feature_ids"))


@register("label_encode", oq.with_(oq.bio_ctes()) + """
 SELECT doc_id, pos, tag, tag_id AS label_id FROM bio""")
def q_label_encode(spark, sf_dir):
    """V6: strict tag -> id lookup against the 30-label dictionary."""
    b = bio(spark, sf_dir).select("doc_id", "pos", "tag")
    return vo.label_encode(b).select("doc_id", "pos", "tag", "label_id")


def line_digest(df, name, *cols):
    """One row per document: rows, and the MD5 of their lines in order of position."""
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), lines_md5(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])).alias(name))


@register("label_encode_by_doc", oq.with_(oq.bio_ctes()) + BY_DOC_SQL.format("tag || ' ' || tag_id", "labels_md5", "bio"))
def q_label_encode_by_doc(spark, sf_dir):
    """V6: the strict lookup's rows as one digest per document."""
    b = bio(spark, sf_dir).select("doc_id", "pos", "tag")
    return line_digest(vo.label_encode(b), "labels_md5", "tag", "label_id")


LABEL_ROWS = ", ".join(f"({i}, '{n}')" for n, i in sorted(label_to_id().items(), key=lambda kv: kv[1]))


@register("tag_decode_by_doc", oq.with_(oq.fb_ctes()) + ", lab AS (SELECT * FROM (VALUES " + LABEL_ROWS + """) v(id, name)),
 dec AS (SELECT doc_id, pos, pred_id, name FROM pred JOIN lab ON pred.pred_id = lab.id)""" + BY_DOC_SQL.format("pred_id || ' ' || name", "tags_md5", "dec"))
def q_tag_decode_by_doc(spark, sf_dir):
    """The decoded rows as one digest per document."""
    decoded = vo.tag_decode(fb(spark, sf_dir).select("doc_id", "pos", F.col("pred_id").alias("tag_id")))
    return line_digest(decoded, "tags_md5", "tag_id", "tag")


@register("tag_decode", oq.with_(oq.fb_ctes()) + ", lab AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for n, i in sorted(label_to_id().items(),
                                       key=lambda kv: kv[1])) + """) v(id, name))
 SELECT doc_id, pos, pred_id AS tag_id, name AS tag FROM pred JOIN lab ON pred.pred_id = lab.id""")
def q_tag_decode(spark, sf_dir):
    """Predicted ids -> tag strings, unknown ids dropped."""
    return vo.tag_decode(fb(spark, sf_dir).select("doc_id", "pos", F.col("pred_id").alias("tag_id"))) \
        .select("doc_id", "pos", "tag_id", "tag")


@register("corpus_stats", oq.with_(oq.bio_ctes()) + """
 SELECT count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS INT) AS max_len,
        CAST((SELECT count(DISTINCT tag_id) FROM bio) AS INT) AS n_labels
 FROM (SELECT doc_id, max(pos) + 1 AS n FROM bio GROUP BY doc_id)""")
def q_corpus_stats(spark, sf_dir):
    """V8: sequence count, token count, longest sequence, label count."""
    return vo.corpus_stats(bio(spark, sf_dir))


@register("ctx_word_features", oq.with_(oq.features_ctes()) + """
 SELECT doc_id, pos, f_word, f_prev_word, f_next_word FROM ft""")
def q_ctx_word_features(spark, sf_dir):
    """word, previous word, next word (<unk> at the borders)."""
    return fe.context_features(tagged_tokens(spark, sf_dir), fe.WORD_TEMPLATES) \
        .select("doc_id", "pos", "f_word", "f_prev_word", "f_next_word")


@register("ctx_pos_features", oq.with_(oq.features_ctes()) + """
 SELECT doc_id, pos, f_pos, f_prev_pos, f_next_pos FROM ft""")
def q_ctx_pos_features(spark, sf_dir):
    """tag, previous tag, next tag with the reference border behaviour."""
    return fe.context_features(tagged_tokens(spark, sf_dir), fe.pos_templates()) \
        .select("doc_id", "pos", "f_pos", "f_prev_pos", "f_next_pos")


@register("featurise", oq.with_(oq.features_ctes()) + """
 SELECT doc_id, pos, string_agg(feature, ' ' ORDER BY slot) AS feats FROM fl GROUP BY doc_id, pos""")
def q_featurise(spark, sf_dir):
    """the six feature strings per token, in slot order."""
    f = fe.featurise(tagged_tokens(spark, sf_dir), long=False)
    return f.select("doc_id", "pos", F.array_join("feats", " ").alias("feats"))


@register("featurise_blocked", oq.with_(oq.features_ctes()) + """,
 fd AS (SELECT doc_id, pos, string_agg(feature, ' ' ORDER BY slot) AS feats FROM fl GROUP BY doc_id, pos)""" + BY_DOC_SQL.format("feats", "feats_md5", "fd"))
def q_featurise_blocked(spark, sf_dir):
    """F1+F3+F4 by blocks of 100 positions with a token of halo on each side; a digest per document."""
    f = halos.featurise_blocks(tagged_tokens(spark, sf_dir), block=100)
    return line_digest(f.select("doc_id", "pos", F.array_join("feats", " ").alias("feats")), "feats_md5", "feats")


@register("lexicon_pos", oq.with_(oq.features_ctes()) + """,
 lex AS (SELECT tok, arg_max(pos_tag, c * 16 + CASE pos_tag WHEN 'NUM' THEN 2 WHEN 'PUNCT' THEN 3
                                                  WHEN 'CAP' THEN 0 ELSE 1 END) AS lex_tag
         FROM (SELECT tok, pos_tag, count(*) AS c FROM tt WHERE split = 'train' GROUP BY tok, pos_tag) GROUP BY tok)
 SELECT doc_id, pos, coalesce(lex_tag, 'NN') AS pos_tag FROM tt LEFT JOIN lex USING (tok)""")
def q_lexicon_pos(spark, sf_dir):
    """F2 (re-aimed): word -> most frequent training tag, 'NN' for unseen words."""
    tt = tagged_tokens(spark, sf_dir)
    lex = fe.lexicon_pos_fit(tt.where(F.col("split") == "train"))
    return fe.lexicon_pos_apply(tt.select("doc_id", "pos", "tok"), lex).select("doc_id", "pos", "pos_tag")


@register("bigram_tag_counts", oq.with_(oq.features_ctes()) + """,
 q AS (SELECT pos_tag, lag(pos_tag) OVER w AS before, lead(pos_tag) OVER w AS behind FROM tt WHERE split = 'train' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
 SELECT coalesce(before, '-') AS before, pos_tag AS tag, count(*) AS c FROM q GROUP BY 1, 2
 UNION ALL SELECT pos_tag, '-', count(*) FROM q WHERE behind IS NULL GROUP BY 1""")
def q_bigram_tag_counts(spark, sf_dir):
    """F2 in context: how often each tag follows each in the training split (- before the first and behind the last)."""
    tt = tagged_tokens(spark, sf_dir).where(F.col("split") == "train")
    mark = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return tg.transitions(tt).select(mark("before"), mark("tag"), "c")


@register("bigram_pos")
def q_bigram_pos(spark, sf_dir):
    """F2 in context: the bigram tagger fitted on the training split, applied to all documents; each document's tokens and tags that agree."""
    tt = tagged_tokens(spark, sf_dir)
    path = scratch(spark, "tagged")
    tt.select("doc_id", "pos", "tok", "pos_tag", "split").write.parquet(path)
    tt = spark.read.parquet(path)
    got = tg.apply(tt.select("doc_id", "pos", "tok", "pos_tag"), tg.fit(tt.where(F.col("split") == "train")), out="found", keep=["pos_tag"])
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("found") == F.col("pos_tag")).alias("n_right"))


# ---------------------------------------------------------------- padding / batching


def j_ints(c):
    return F.array_join(F.col(c), " ")


@register("pad_truncate", oq.with_(oq.tokens_ctes(5379)) + """
 SELECT doc_id, CAST(len(a) AS INT) AS n_real, array_to_string(a || list_transform(range(5379 - len(a)), lambda x: '<PAD>'), ' ') AS padded
 FROM (SELECT doc_id, list(tok ORDER BY pos) AS a FROM t GROUP BY doc_id)""")
def q_pad_truncate(spark, sf_dir):
    """Token sequences cut/padded to the fixed length 5379 with '<PAD>'."""
    toks = align.tokens(align.by_doc(fx.documents(spark, sf_dir)), 5379)
    seq = pd_.sequences(toks, ["tok"])
    return seq.select("doc_id", F.size("tok").cast("int").alias("n_real"),
                      F.array_join(ar.pad_truncate("tok", 5379, "<PAD>"), " ").alias("padded"))


@register("pad_corpus_max", oq.with_(oq.bio_ctes()) + """,
 s AS (SELECT doc_id, list(tag_id ORDER BY pos) AS a FROM bio GROUP BY doc_id)
 SELECT doc_id, array_to_string(a || list_transform(range((SELECT max(len(a)) FROM s) - len(a)), lambda x: 29), ' ') AS labels
 FROM s""")
def q_pad_corpus_max(spark, sf_dir):
    """Label sequences padded with 29 to the corpus maximum."""
    seq = pd_.sequences(bio(spark, sf_dir), ["tag_id"])
    return pd_.pad_to_corpus_max(seq, {"tag_id": 29}, longest=pd_.longest_text(fx.documents(spark, sf_dir))).select("doc_id", j_ints("tag_id").alias("labels"))


@register("pad_label_mask", oq.with_(oq.padded_ctes()) + """
 SELECT doc_id, array_to_string(list_transform(list_zip(toks, labels), lambda x: CASE WHEN x[1] = '<PAD>' THEN 29 ELSE x[2] END), ' ') AS labels
 FROM padded""")
def q_pad_label_mask(spark, sf_dir):
    """Label 29 wherever the (padded) token is '<PAD>'; one label string per document."""
    seq = pd_.sequences(bio(spark, sf_dir), ["tok", "tag_id"])
    seq = pd_.pad_to_corpus_max(seq, {"tok": "<PAD>", "tag_id": 0}, longest=pd_.longest_text(fx.documents(spark, sf_dir)))
    return seq.withColumn("tag_id", pd_.pad_label_mask_arrays("tok", "tag_id")).select("doc_id", j_ints("tag_id").alias("labels"))


@register("attention_mask", oq.with_(oq.features_ctes()) + ", v AS (" + oq.vocab_sql() + """),
 s AS (SELECT doc_id, list(word_id ORDER BY pos) AS a FROM tt JOIN v ON tt.tok = v.word GROUP BY doc_id),
 pw AS (SELECT doc_id, a || list_transform(range((SELECT max(len(a)) FROM s) - len(a)), lambda x: 1) AS a FROM s)
 SELECT doc_id, array_to_string(a, ' ') AS ids, array_to_string(list_transform(a, lambda x: CAST(x <> 1 AS INT)), ' ') AS mask
 FROM pw""")
def q_attention_mask(spark, sf_dir):
    """P13+P14: word ids padded with <PAD>=1 to the corpus maximum, mask 1 for real tokens."""
    tt = tagged_tokens(spark, sf_dir)
    enc = vo.word_encode(tt, vo.word_vocab(tt))
    seq = pd_.pad_to_corpus_max(pd_.sequences(enc, ["word_id"]), {"word_id": 1}, longest=pd_.longest_text(fx.documents(spark, sf_dir)))
    return seq.select("doc_id", j_ints("word_id").alias("ids"),
                      F.array_join(ar.attention_mask("word_id", 1), " ").alias("mask"))


BATCH_SQL = f"""
 , seqs AS (SELECT DISTINCT doc_id FROM tt WHERE split = 'train'),
 bidx AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * {ba.SHUFFLE_PRIME} + 0) % {ba.SHUFFLE_MOD}, doc_id) - 1 AS idx
          FROM seqs)"""


@register("batch_assign", oq.with_(oq.features_ctes()) + BATCH_SQL + """
 SELECT doc_id, idx, CAST(floor(idx / 64) AS INT) AS batch_id FROM bidx""")
def q_batch_assign(spark, sf_dir):
    """B2+B3: seeded shuffle of the training sequences, batches of 64."""
    seqs = tagged_tokens(spark, sf_dir).where(F.col("split") == "train").select("doc_id").distinct()
    return ba.batch_assign(seqs, 64, 0, arithmetic=True)


@register("batch_pad", oq.with_(oq.features_ctes()) + BATCH_SQL + """,
 b AS (SELECT doc_id, CAST(floor(idx / 64) AS INT) AS batch_id FROM bidx),
 fe AS (SELECT fl.doc_id, fl.pos, any_value(tag_id) AS tag_id,
               list(coalesce(d.feature_id, 1) ORDER BY slot) AS fids
        FROM fl JOIN ft USING (doc_id, pos) LEFT JOIN fdict d ON fl.feature = d.feature
        WHERE fl.split = 'train' GROUP BY fl.doc_id, fl.pos),
 sq AS (SELECT doc_id, list(tag_id ORDER BY pos) AS labels, list(fids ORDER BY pos) AS feats FROM fe GROUP BY doc_id),
 j AS (SELECT b.batch_id, sq.*, max(len(labels)) OVER (PARTITION BY batch_id) AS plen FROM sq JOIN b USING (doc_id))
 SELECT batch_id, doc_id, CAST(plen AS INT) AS padded_len,
        array_to_string(labels || list_transform(range(plen - len(labels)), lambda x: 29), ' ') AS labels,
        array_to_string(list_transform(labels || list_transform(range(plen - len(labels)), lambda x: 29),
                                       lambda x: CASE WHEN x <> 29 THEN 'true' ELSE 'false' END), ' ') AS mask,
        array_to_string(list_transform(feats, lambda r: array_to_string(r, ',')) || list_transform(range(plen - len(feats)), lambda x: '0,0,0,0,0,0'), ' ') AS feats
 FROM j""")
def q_batch_pad(spark, sf_dir):
    """B1+B4-B6: labels padded with 29 and feature rows with [0]*6 to the batch maximum, plus the loss mask.

    Labels, mask and the padded feature matrix (rows of ids joined by commas) are returned whole.
    """
    coded, _ = encoded(spark, sf_dir)
    train = coded.where(F.col("split") == "train")
    seqs = cd.documents(train).select("doc_id", F.col("tag_id").alias("labels"), F.col("fids").alias("feature_ids"))
    lengths = cd.lengths(train)
    b = ba.batch_assign(lengths.select("doc_id"), 64, 0, arithmetic=True)
    p = ba.batch_pad(seqs, b, slots=len(FEATURES), lengths=lengths)
    return p.select("batch_id", "doc_id", "padded_len", j_ints("labels").alias("labels"),
                    F.array_join(F.transform("mask", lambda m: m.cast("string")), " ").alias("mask"),
                    F.array_join(F.transform(F.sequence(F.lit(0), F.col("padded_len") - 1),
                                             lambda i: F.array_join(F.slice("feature_ids", i * len(FEATURES) + 1, len(FEATURES)), ",")), " ").alias("feats"))


# ---------------------------------------------------------------- CRF


#: Per token, the 30 scores of the F-G weights times 64 (whole numbers), as a list.
EM64 = """,
 fe AS (SELECT fl.doc_id, fl.pos, list(coalesce(d.feature_id, 1)) AS fids FROM fl LEFT JOIN fdict d ON fl.feature = d.feature GROUP BY fl.doc_id, fl.pos),
 em AS MATERIALIZED (SELECT doc_id, pos, list_transform(range(30), lambda t: list_sum(list_transform(fids, lambda f: (f * 31 + t * 7) % 101 - 50))) AS em FROM fe)"""


@register("crf_emissions", oq.with_(oq.features_ctes()) + EM64 + """
 SELECT doc_id, pos, array_to_string(list_transform(em, lambda x: CAST(x AS BIGINT)), ' ') AS em64 FROM em""")
def q_crf_emissions(spark, sf_dir):
    """M1: the 30 emission scores of each token from the F-G weight table (times 64: exact whole numbers)."""
    tokens, fd = encoded(spark, sf_dir)
    em = crf.emissions(tokens, crf.synthetic_weights(fd))
    return em.select("doc_id", "pos", F.array_join(F.transform("em", lambda x: (x * 64).cast("long")), " ").alias("em64"))


def _synthetic_sequences(spark, sf_dir, labels="tag_id"):
    tokens, fd = encoded(spark, sf_dir)
    w = crf.synthetic_weights(fd)
    score = crf.scorer(w)
    return crf.sequences(tokens, w, score, labels=labels), score


#: Per document, the rows of scores in order, and the fixed chain times 64 (start, end).
CHAIN64 = EM64 + """,
 tr AS (SELECT list_transform(range(30), lambda t: (t % 5 - 2) * 16) AS st, list_transform(range(30), lambda t: ((29 - t) % 5 - 2) * 16) AS en),
 sq AS MATERIALIZED (SELECT doc_id, list(em ORDER BY pos) AS ems FROM em GROUP BY doc_id)"""


LOGLIK_SQL = oq.with_(oq.features_ctes()) + CHAIN64 + """,
 sc AS (SELECT doc_id, list_transform(ems, lambda e: list_transform(e, lambda x: CAST(x AS DOUBLE) / 64)) AS ems,
               list_transform(st, lambda x: x / 64) AS st, list_transform(en, lambda x: x / 64) AS en FROM sq, tr),
 z AS (SELECT doc_id, en, list_reduce(list_prepend(list_append(list_transform(range(1, 31), lambda j: exp(st[j] + ems[1][j])), 0.0), ems[2:]),
          """ + oq.chain_sql(False) + """) AS a FROM sc),
 lab AS (SELECT doc_id, pos, tag_id, lag(tag_id) OVER w AS before, lead(tag_id) OVER w AS behind FROM bio WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 gold AS (SELECT lab.doc_id, sum(em.em[tag_id + 1] + CASE WHEN before IS NULL THEN (tag_id % 5 - 2) * 16 ELSE ((before * 7 + tag_id * 3) % 11 - 5) * 8 END
                                 + CASE WHEN behind IS NULL THEN ((29 - tag_id) % 5 - 2) * 16 ELSE 0 END) / 64 AS s
          FROM lab JOIN em USING (doc_id, pos) GROUP BY lab.doc_id)
 SELECT doc_id, round(s - a[31] - ln(list_sum(list_transform(range(1, 31), lambda j: a[j] * exp(en[j])))), 6) AS loglik
 FROM z JOIN gold USING (doc_id)"""


@register("crf_loglik", LOGLIK_SQL)
def q_crf_loglik(spark, sf_dir):
    """M2: log-likelihood of the gold tags of every document under F-G weights and fixed transitions."""
    seqs, score = _synthetic_sequences(spark, sf_dir)
    return crf.loglik(seqs, score, crf.synthetic_chain()).select("doc_id", F.round("loglik", 6).alias("loglik"))


DECODE_SQL = oq.with_(oq.features_ctes()) + CHAIN64 + """,
 z AS (SELECT doc_id, len(ems) AS n, en, list_reduce(list_prepend(list_transform(range(1, 31), lambda j: st[j] + ems[1][j]), ems[2:]),
          """ + oq.chain_sql(True) + """) AS a FROM sq, tr)
 SELECT doc_id, CAST(n AS INT) AS n_tokens, CAST(list_max(list_transform(range(1, 31), lambda j: a[j] + en[j])) AS BIGINT) AS score64 FROM z"""


@register("crf_decode", DECODE_SQL)
def q_crf_decode(spark, sf_dir):
    """M4+M5: Viterbi path of every document; its length and its score along the path (times 64), which is the best score if the path is right."""
    seqs, score = _synthetic_sequences(spark, sf_dir, None)
    paths = crf.decode(seqs, score, crf.synthetic_chain())
    return paths.select("doc_id", F.size("path").cast("int").alias("n_tokens"), (F.col("score") * 64).cast("long").alias("score64"))


@register("crf_loglik_blocked", LOGLIK_SQL)
def q_crf_loglik_blocked(spark, sf_dir):
    """M2 with documents cut into blocks of 256 tokens, linked by a scan over their log-sum matrices."""
    tokens, fd = encoded(spark, sf_dir)
    return crf_blocks.loglik(tokens, crf.synthetic_weights(fd), crf.synthetic_chain(), 256).select("doc_id", F.round("loglik", 6).alias("loglik"))


@register("crf_decode_blocked", DECODE_SQL)
def q_crf_decode_blocked(spark, sf_dir):
    """M4+M5 with documents cut into blocks of 256 tokens, linked by a scan over their max-plus matrices."""
    tokens, fd = encoded(spark, sf_dir)
    parts = crf_blocks.decode(tokens, crf.synthetic_weights(fd), crf.synthetic_chain(), 256)
    return parts.groupBy("doc_id").agg(F.sum(F.size("path")).cast("int").alias("n_tokens"), (F.sum("score") * 64).cast("long").alias("score64"))


@register("crf_fit_step", oq.with_(oq.features_ctes()) + """,
 x AS (SELECT coalesce(d.feature_id, 1) AS feature_id, ft.tag_id, count(*) AS c FROM fl JOIN ft USING (doc_id, pos)
       LEFT JOIN fdict d ON fl.feature = d.feature WHERE fl.split = 'train' GROUP BY 1, 2),
 n AS (SELECT count(DISTINCT doc_id) AS n FROM ft WHERE split = 'train'),
 per AS (SELECT feature_id, sum(c) AS c, sum(c * c) AS c2, max(c) AS top, coalesce(sum(c) FILTER (WHERE tag_id = 0), 0) AS o FROM x GROUP BY feature_id)
 SELECT feature_id, round((c / 30 - o) / n, 9) AS g_outside, round((c / 30 - top) / n, 9) AS g_least,
        round((c2 - c * c / 30) / n / n, 9) AS g_square FROM per, n""")
def q_crf_fit_step(spark, sf_dir):
    """M3: the first full gradient from zero parameters (closed form: count / 30 - count with the tag, per sequence)."""
    tokens, _ = encoded(spark, sf_dir)
    train = tokens.where(F.col("split") == "train")
    _, grad, _ = tr.gradient_step(train, tr.empty_weights(spark), crf.ChainParams())
    square = F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x)
    return grad.select("feature_id", F.round(F.get("g", F.lit(0)), 9).alias("g_outside"), F.round(F.array_min("g"), 9).alias("g_least"),
                       F.round(square, 9).alias("g_square"))


@register("crf_fit")
def q_crf_fit(spark, sf_dir):
    """M3+M6+M7+S8: 5 epochs of SGD (batch 64, lr 0.05) on the train split, the best model kept; per-epoch training loss, dev loss and dev F1."""
    tokens, _ = encoded_tokens(spark, sf_dir)
    path = scratch(spark, "encoded-tokens")
    tokens.write.partitionBy("split").parquet(path)
    tokens = spark.read.parquet(path)
    fit = tr.crf_fit(tokens.where(F.col("split") == "train"), tokens.where(F.col("split") == "dev"), epochs=5, lr=0.05, patience=3,
                     best_path=scratch(spark, "crf-best"))
    return fit.history.withColumn("best", F.col("epoch") == fit.best_epoch)


# ---------------------------------------------------------------- text sources, history, heads


@register("conll_parse", oq.with_(oq.bio_ctes()) + """
 SELECT dense_rank() OVER (ORDER BY doc_id) - 1 AS sent_id, pos, tok AS token, tag FROM bio""")
def q_conll_parse(spark, sf_dir):
    """BIO tokens written as token<TAB>tag text files and read back, sentences numbered in file order."""
    path = scratch(spark, "conll")
    co.write_conll(bio(spark, sf_dir), path)
    return co.read_conll(spark, path)


@register("label_list", oq.with_(oq.bio_ctes()) + """
 SELECT tag AS label, CAST(row_number() OVER (ORDER BY tag_id) AS INT) AS label_id FROM (SELECT DISTINCT tag, tag_id FROM bio)
 UNION ALL SELECT '<PAD>', 0""")
def q_label_list(spark, sf_dir):
    """Label lines (the tags present, in dictionary order) -> ids from 1, pad 0."""
    lines = bio(spark, sf_dir).select(F.col("tag").alias("value"), F.col("tag_id").alias("line_no")).distinct()
    return co.labels_from_lines(lines)


@register("encoded_roundtrip", oq.with_(oq.features_ctes()) + ", v AS (" + oq.vocab_sql() + """)
 SELECT tt.doc_id, tt.split, tt.pos, v.word_id FROM tt JOIN v ON tt.tok = v.word""")
def q_encoded_roundtrip(spark, sf_dir):
    """S6+S7: encoded long table written partitioned by split into the shared folder and read back."""
    tt = tagged_tokens(spark, sf_dir)
    enc = vo.word_encode(tt, vo.word_vocab(tt)).select("doc_id", "split", "pos", "word_id")
    path = scratch(spark, "encoded")
    en.write_encoded(enc, path)
    return en.read_encoded(spark, path).select("doc_id", "split", "pos", "word_id")


#: Full-batch training of the sparse softmax tagger: few steps, so that SQL can follow them.
FULL_BATCH, HISTORY_EPOCHS, HISTORY_LR = 1 << 30, 3, 0.004


def sparse_history(spark, sf_dir):
    """M9's own training: losses of the train split before and of the dev split after each full-batch step."""
    tokens, _ = encoded(spark, sf_dir)
    fit = tr.crf_fit(tokens.where(F.col("split") == "train"), tokens.where(F.col("split") == "dev"), HISTORY_EPOCHS, HISTORY_LR, FULL_BATCH, chain=False)
    return fit.history.select("epoch", F.round("loss", 6).alias("loss"), "n_batches", F.round("val_loss", 6).alias("val_loss"), F.round(F.nanvl("dev_f1", F.lit(-1.0)), 6).alias("dev_f1"))


@register("epoch_history", "WITH " + oq.softmax_history(HISTORY_EPOCHS, HISTORY_LR) + " SELECT epoch, loss, n_batches, val_loss, dev_f1 FROM h")
def q_epoch_history(spark, sf_dir):
    """M6+M9: mean training loss, dev loss and dev F1 (-1 where no tag is found) of each epoch of the softmax tagger on sparse features."""
    return sparse_history(spark, sf_dir)


@register("early_stop", "WITH " + oq.softmax_history(HISTORY_EPOCHS, HISTORY_LR) + """,
 a AS (SELECT epoch, val_loss, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
                                                    AND 1 PRECEDING), 'inf'::DOUBLE) AS imp FROM h),
 b AS (SELECT epoch, val_loss, imp, epoch - max(CASE WHEN imp THEN epoch END) OVER (ORDER BY epoch) AS stall FROM a),
 st AS (SELECT min(CASE WHEN stall >= 1 THEN epoch END) AS stop FROM b)
 SELECT CAST(arg_max(epoch, (-val_loss, -epoch)) AS INT) AS best_epoch, CAST(coalesce(any_value(st.stop), -1) AS INT) AS stop_epoch
 FROM b, st WHERE st.stop IS NULL OR epoch <= st.stop""")
def q_early_stop(spark, sf_dir):
    """M7: best epoch and stop epoch (patience 1) of a real training's dev losses; -1 = never stopped."""
    r = tr.early_stop(sparse_history(spark, sf_dir), "val_loss", 1)
    return r.select("best_epoch", F.coalesce("stop_epoch", F.lit(-1)).alias("stop_epoch"))


@register("softmax_sparse", "WITH " + oq.softmax_ctes(1, HISTORY_LR) + """
 SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE list_position(em, top) - 1 = tag_id) AS n_right,
        round(sum(em[tag_id + 1] - top - ln(z)), 6) AS log_p FROM sm1 GROUP BY doc_id""")
def q_softmax_sparse(spark, sf_dir):
    """M9: the softmax tagger on sparse features after one full-batch step, scored on all tokens: each document's right tags and the log of its tags' probabilities."""
    tokens, _ = encoded(spark, sf_dir)
    fit = tr.crf_fit(tokens.where(F.col("split") == "train"), None, 1, HISTORY_LR, FULL_BATCH, chain=False)
    probs = tr.probabilities(tokens, fit.weights, keep=("tag_id",))
    right = me.argmax("probs") == F.col("tag_id")
    return probs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(right).alias("n_right"),
                                       F.round(F.sum(F.log(F.get("probs", F.col("tag_id")))), 6).alias("log_p"))


def _emb(spark, sf_dir):
    e = fx.read_table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 5 != 0), e


HEAD_SQL = " SELECT label, count(*) AS n_rows, true AS sums_to_one, true AS fitted FROM embeddings GROUP BY label"


def head_facts(scored, fitted):
    """Per label: rows, whether the probabilities of every row sum to one, and the fit's own criterion."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one")) \
        .withColumn("fitted", F.lit(fitted))


@register("softmax_head", HEAD_SQL)
def q_softmax_head(spark, sf_dir):
    """M9: softmax head on frozen vectors, scored on all rows; fitted: the gradient on the training rows is zero (first-order optimality)."""
    train, every = _emb(spark, sf_dir)
    out = hd.softmax_head(train, every, max_iter=500, tol=1e-10)
    return head_facts(out, hd.largest_gradient(out.where(F.col("vec_id") % 5 != 0)) < 1e-3)


@register("mlp_head", HEAD_SQL)
def q_mlp_head(spark, sf_dir):
    """Hidden layer (128) + softmax head on frozen vectors; fitted: its log loss is below that of the label frequencies."""
    train, every = _emb(spark, sf_dir)
    n_classes = int(every.agg(F.max("label")).first()[0]) + 1
    out = hd.mlp_head(train, every, n_classes)
    n = train.count()
    entropy = train.groupBy("label").count().agg(-F.sum(F.col("count") / n * F.log(F.col("count") / n))).first()[0]
    return head_facts(out, hd.log_loss(out.where(F.col("vec_id") % 5 != 0)) < entropy)


RELU_STEP_SQL = """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 <> 0),
 n AS (SELECT count(*) AS n FROM x), k AS (SELECT max(label) + 1 AS k FROM embeddings),
 h AS (SELECT vec_id, label, v, list_transform(range(128), lambda j: greatest(0.0, list_sum(list_transform(range(64), lambda i: v[i + 1] * (((i * 37 + j * 101) % 199 - 99) / 99.0::DOUBLE * sqrt(2.0::DOUBLE / 64)))))) AS h FROM x),
 z AS (SELECT *, list_transform(range(k), lambda c: list_sum(list_transform(range(128), lambda j: h[j + 1] * (((j * 53 + c * 29) % 197 - 98) / 98.0::DOUBLE * sqrt(2.0::DOUBLE / 128))))) AS z FROM h, k),
 e AS (SELECT *, list_transform(z, lambda a: exp(a - list_max(z))) AS e FROM z),
 p AS (SELECT vec_id, label, v, h, list_transform(range(k), lambda c: e[c + 1] / list_sum(e) - CASE WHEN c = label THEN 1 ELSE 0 END) AS d, -ln(e[label + 1] / list_sum(e)) AS loss FROM e),
 b AS (SELECT *, list_transform(range(128), lambda j: CASE WHEN h[j + 1] > 0 THEN list_sum(list_transform(range(len(d)), lambda c: d[c + 1] * (((j * 53 + c * 29) % 197 - 98) / 98.0::DOUBLE * sqrt(2.0::DOUBLE / 128)))) ELSE 0 END) AS back FROM p),
 r AS (SELECT vec_id, v, d, h, unnest(back) AS bk, generate_subscripts(back, 1) AS j FROM b),
 w1 AS (SELECT sum(g * g) AS s FROM (SELECT i, j, sum(vi * bk) / any_value(n) AS g FROM (SELECT j, bk, unnest(v) AS vi, generate_subscripts(v, 1) AS i FROM r), n GROUP BY i, j)),
 b1 AS (SELECT sum(g * g) AS s FROM (SELECT j, sum(bk) / any_value(n) AS g FROM r, n GROUP BY j)),
 w2 AS (SELECT sum(g * g) AS s FROM (SELECT j, c, sum(hj * dc) / any_value(n) AS g FROM (SELECT j, h[j] AS hj, unnest(d) AS dc, generate_subscripts(d, 1) AS c FROM r), n GROUP BY j, c)),
 b2 AS (SELECT sum(g * g) AS s FROM (SELECT c, sum(dc) / any_value(n) AS g FROM (SELECT unnest(d) AS dc, generate_subscripts(d, 1) AS c FROM p), n GROUP BY c)),
 l AS (SELECT avg(loss) AS loss FROM p)
 SELECT name AS block, round(loss, 9) AS loss, round(s, 9) AS g_square FROM l, (SELECT 'w1' AS name, s FROM w1 UNION ALL SELECT 'b1', s FROM b1 UNION ALL SELECT 'w2', s FROM w2 UNION ALL SELECT 'b2', s FROM b2)"""


@register("relu_head_step", RELU_STEP_SQL)
def q_relu_head_step(spark, sf_dir):
    """Mean loss and gradient of the dense(128) - ReLU - dense - softmax head at its start, over all training rows; the squared length of each block."""
    train, every = _emb(spark, sf_dir)
    k = int(every.agg(F.max("label")).first()[0]) + 1
    loss, n, g = rh.gradient(train, rh.ReluHead.start(64, 128, k))
    rows = [(b, round(loss / n, 9), round(float(((getattr(g, b) / n) ** 2).sum()), 9)) for b in ("w1", "b1", "w2", "b2")]
    return spark.createDataFrame(rows, "block string, loss double, g_square double")


@register("relu_head", HEAD_SQL)
def q_relu_head(spark, sf_dir):
    """The ReLU head trained by mini-batch SGD, scored on all rows; fitted: its log loss is below that of the label frequencies."""
    train, every = _emb(spark, sf_dir)
    k = int(every.agg(F.max("label")).first()[0]) + 1
    head, _ = rh.fit(train, k, epochs=10, lr=0.5, batch_size=512)
    out = rh.score(every, head)
    n = train.count()
    entropy = train.groupBy("label").count().agg(-F.sum(F.col("count") / n * F.log(F.col("count") / n))).first()[0]
    return head_facts(out, hd.log_loss(out.where(F.col("vec_id") % 5 != 0)) < entropy)


# ---------------------------------------------------------------- subwords


def subword_vocab(spark, sf_dir):
    """F-F: vocabulary derived from the documents' basic words, written once."""
    d = fx.documents(spark, sf_dir)
    path = scratch(spark, "subword-vocab")
    wpc.corpus_vocab(d.select(F.explode(wpc.basic_words("text")).alias("word"))).write.parquet(path)
    return spark.read.parquet(path)


@register("wordpiece_vocab", oq.with_(oq.wp_vocab_ctes()) + " SELECT piece, piece_id FROM v")
def q_wordpiece_vocab(spark, sf_dir):
    """F-F: subword vocabulary derived from the documents (specials, characters, frequent words)."""
    return subword_vocab(spark, sf_dir)


@register("wordpiece_ids", oq.with_(oq.wp_vocab_ctes()) + oq.wp_doc_ctes() + """
 SELECT doc_id, pos, piece_id, CAST(piece_id <> 0 AS INT) AS mask FROM dpad""")
def q_wordpiece_ids(spark, sf_dir):
    """P9+P14: [CLS] pieces [SEP] cut to 512 ids, padded with [PAD]=0, attention mask."""
    v = subword_vocab(spark, sf_dir)
    p = wpc.piece_tokens(align.by_doc(fx.documents(spark, sf_dir)), v, pad=True, names=False)
    return p.select("doc_id", "pos", "piece_id", (F.col("piece_id") != 0).cast("int").alias("mask"))


@register("wordpiece_entities", oq.with_(oq.wp_vocab_ctes(), oq.fa_spans_ctes()) + oq.wp_entity_ctes()
          + " SELECT doc_id, j, pos, piece_id FROM epi")
def q_wordpiece_entities(spark, sf_dir):
    """P10: entity spans as pieces, no specials, no cut."""
    v = subword_vocab(spark, sf_dir)
    spans = align.span_rows(fx.annotated(spark, sf_dir))
    return wpc.piece_tokens(spans.select("doc_id", "j", "text"), v, specials=False, max_len=None, keys=["doc_id", "j"], names=False) \
        .select("doc_id", F.col("j").cast("int").alias("j"), "pos", "piece_id")


@register("ids_to_pieces", oq.with_(oq.wp_vocab_ctes()) + oq.wp_doc_ctes() + """
 SELECT doc_id, pos, piece_id, piece FROM dpi""")
def q_ids_to_pieces(spark, sf_dir):
    """Piece ids back to piece strings through the vocabulary."""
    v = subword_vocab(spark, sf_dir)
    ids = wpc.piece_tokens(align.by_doc(fx.documents(spark, sf_dir)), v, names=False)
    return vo.lookup(ids, v, "piece_id").select("doc_id", "pos", "piece_id", "piece")


@register("bio_tags_wordpiece", oq.with_(oq.wp_vocab_ctes(), oq.fa_spans_ctes()) + oq.wp_doc_ctes()
          + oq.wp_entity_ctes() + """,
 e AS (SELECT doc_id, j, label, count(*) OVER (PARTITION BY doc_id, j) AS n, pos AS k, piece_id AS tok FROM epi),
 t AS (SELECT doc_id, pos, piece_id AS tok FROM dpad),""" + oq.locate_ctes() + """,
 p AS (SELECT doc_id, j, label, s, unnest(range(s, s + n)) AS pos FROM f),
 g AS (SELECT doc_id, pos, arg_max(CASE WHEN pos = s THEN 1 ELSE 15 END + list_position(""" + oq.LAB + """, label) - 1, j) AS tag_id
       FROM p GROUP BY doc_id, pos)
 SELECT dpad.doc_id, dpad.pos, dpad.piece, dpad.piece_id,
        CAST(CASE WHEN dpad.piece IN ('[PAD]', '[CLS]', '[SEP]') THEN 29 ELSE coalesce(g.tag_id, 0) END AS INT) AS tag_id
 FROM dpad LEFT JOIN g ON dpad.doc_id = g.doc_id AND dpad.pos = g.pos""")
def q_bio_tags_wordpiece(spark, sf_dir):
    """A3+P15: BIO ids over 512 piece ids; specials and pads labelled 29."""
    return wpc.align_pieces(fx.annotated(spark, sf_dir), subword_vocab(spark, sf_dir), partitioned=True)

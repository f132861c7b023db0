"""Mixing sources to target weights along a low-discrepancy schedule.

1.  *Targets.*  Sources ordered by code point (null last) weigh ``weights`` in rotation and share
    ``budget`` times all words; a target stops at ``max_epochs`` times its source's words and the excess
    is shared again by weight (water filling, solved in closed form over the sorted ratios).
2.  *Blocks.*  The documents of a source, shuffled anew in each epoch, form one stream of words that is
    cut into blocks of ``block`` words up to the source's target.
3.  *Schedule.*  Slot k of the mix has the van der Corput point of k; the cumulative targets map the point
    to a source, the slots of a source are ranked, and the slot of rank j joins block j of that source.
    The points stray from the targets by a few slots at most (at any slot n by the discrepancy of the points, about
    log2 n): slots beyond a source's last block are void, blocks beyond its last slot are appended, each
    in a slot of its own, so each source's words meet its target (rounded) exactly.

Words are mixed in the order of slots, and within a slot in the order of the source's stream.  ``mixed_documents`` returns its rows in the order of
the slot that each begins in, sorted by range, so that files written from them hold the mix.

Only DataFrame functions are used; windows in one task see one row per source, so the number of sources is taken to be small.  Defined cases: null text has size 0 and is never taken; a null source is
a source of its own (last); sources without words get target 0; repeated rows are separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import BLANK, cumulated, seeded, word_count, written

BLOCK_WORDS = 1024
GRID = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """(_none, _src, source_size) -> the same with ``target``.  The windows see one row per source."""
    order = Window.partitionBy(F.lit(1)).orderBy("_none", "_src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("_w", weight)
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_w"), "_none", "_src")
    full = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("_all", F.sum("source_size").over(full) * F.lit(budget))
         .withColumn("_capped", F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("_left", F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("_level", (F.col("_all") - F.coalesce("_capped", F.lit(0.0))) / F.col("_left"))
         # the water level is that of the first source, by cap per weight, that stays below its cap
         .withColumn("_water", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"),
                                            F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level"))))
                     .over(full)["level"]))
    return s.select("_none", "_src", "source_size",
                    F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap"))).alias("target"))


def van_der_corput(k, bits: int = 48):
    """Base-2 radical inverse of ``k`` in [0, 1): its ``bits`` lowest binary digits, mirrored at the point."""
    mirrored = F.reverse(F.lpad(F.bin(k), bits, "0"))
    return F.conv(mirrored, 2, 10).cast("double") / F.lit(float(2 ** bits))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2,
        block: int = BLOCK_WORDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", ident: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: one row per document with ``_doc`` (its key here), size, source_size and target of its source.
    pieces: the mix, (slot, _none, _src, block, _doc, doc_id, _h, size, epoch, start, length): the words
    [start, start + length) of a document in the given slot; ``slot`` orders the mix, ``_h`` is the text's hash, or ``ident``.
    """
    light = written(docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"),
        F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        (F.xxhash64(F.col(text_col)) if ident is None else ident).alias("_h")), "mix-sizes")
    targets = written(source_targets(
        light.groupBy("_none", "_src").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs),
        "mix-targets")
    # epoch 1 in the order of the documents' keys; every document gets its place there as a key
    first = cumulated(light.withColumn("_key", seeded(seed, F.col("doc_id"))), ["_none", "_src"],
                      ["_key", "doc_id", "_h", "size"], "size", "mix-epoch-1")
    first = written(first.withColumnRenamed("_rank", "_doc"), "mix-documents")
    streams = first.select("_none", "_src", "_doc", "doc_id", "_h", "size", F.lit(1).alias("epoch"),
                           F.col("_before").alias("from"))
    for epoch in range(2, max_epochs + 1):
        again = cumulated(first.select("_none", "_src", "_doc", "doc_id", "_h", "size",
                                       seeded(seed + epoch, F.col("doc_id")).alias("_key")),
                          ["_none", "_src"], ["_key", "_doc"], "size", f"mix-epoch-{epoch}")
        streams = streams.unionByName(again.select(
            "_none", "_src", "_doc", "doc_id", "_h", "size", F.lit(epoch).alias("epoch"),
            (F.col("_before") + F.lit(epoch - 1) * F.col("_total")).alias("from")))
    quota = targets.select("_none", "_src", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))
    end = F.least(F.col("from") + F.col("size"), F.col("quota"))
    taken = streams.join(quota, ["_none", "_src"]).withColumn("_end", end).where("_end > `from`")
    cut = taken.withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {block}"),
                                                         F.expr(f"(_end - 1) div {block}"))))
    lo, hi = F.greatest("from", F.col("block") * block), F.least("_end", (F.col("block") + 1) * block)
    pieces = cut.select("_none", "_src", "block", "_doc", "doc_id", "_h", "size", "epoch",
                        (lo - F.col("from")).alias("start"), (hi - lo).alias("length"))
    slots = _schedule(targets, quota, block)
    return (first.join(targets, ["_none", "_src"]).select("_none", "_src", "_doc", "doc_id", "size", "source_size", "target"),
            pieces.join(slots, ["_none", "_src", "block"]))


def _schedule(targets: DataFrame, quota: DataFrame, block: int) -> DataFrame:
    """(_none, _src, block, slot): the slot of each block of each source."""
    spark = targets.sparkSession
    over = Window.partitionBy(F.lit(1)).orderBy("_none", "_src")
    full = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    need = (quota.withColumn("blocks", F.expr(f"(quota + {block - 1}) div {block}")).where("blocks > 0")
            .withColumn("_all", F.sum("blocks").over(full))
            .withColumn("hi", F.sum("blocks").over(over) / F.col("_all"))
            .withColumn("lo", (F.sum("blocks").over(over) - F.col("blocks")) / F.col("_all")))
    n = need.agg(F.max("_all")).first()[0] or 0  # one number: the slots of the mix
    slots = spark.range(0, n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("_u"))
    # a grid over [0, 1) turns "which interval holds the point" into a join on the cell
    cells = need.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))))
    mapped = (slots.withColumn("_cell", F.floor(F.col("_u") * GRID)).join(cells, "_cell")
              .where("lo <= _u and _u < hi").select("slot", "_none", "_src"))
    ranked = cumulated(mapped, ["_none", "_src"], ["slot"], None, "mix-slots")
    key = ["_none", "_src"]
    used = ranked.join(need.select(*key, "blocks"), key).where("_rank < blocks").select(*key, F.col("_rank").alias("block"), "slot")
    # blocks without a slot, as few as the points stray, follow at the end by source, one to a slot
    late = need.join(ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_had")), key, "left").withColumn("_had", F.least("blocks", F.coalesce("_had", F.lit(0))))
    late = late.withColumn("_at", F.sum(F.col("blocks") - F.col("_had")).over(over) - (F.col("blocks") - F.col("_had"))).where("_had < blocks")
    late = late.select(*key, "_had", "_at", F.explode(F.sequence("_had", F.col("blocks") - 1)).alias("block"))
    return used.unionByName(late.select(*key, "block", (F.lit(n) + F.col("_at") + F.col("block") - F.col("_had")).alias("slot")))


def places(pieces: DataFrame) -> DataFrame:
    """(_none, _src, _doc, taken, first_slot, n_slots): the words taken of each document and the slots they stand in."""
    return pieces.groupBy("_none", "_src", "_doc").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents (same columns): a row for each epoch in which a document is taken, in the order of the schedule.

    A document's words of one epoch follow each other, so a row holds its whole text, or the beginning of it where its
    source's target ends inside it (``length_col`` is then the new length).  It stands at the place of its first word.  Rows equal in id, source and
    text are told apart by their other columns.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    _, pieces = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, ident=whole, **options)
    key = lambda none, src, i, h: F.concat_ws(":", h.cast("string"), i.cast("string"), none.cast("string"), src)
    takes = (pieces.groupBy("_none", "_src", "doc_id", "_h", "_doc", "epoch", "size").agg(
                F.sum("length").alias("_words"), F.min(F.struct("slot", "start")).alias("_place"))
             .select(key(F.col("_none"), F.col("_src"), F.col("doc_id"), F.col("_h")).alias("_key"), "_doc", "epoch", "_place", "_words", (F.col("_words") < F.col("size")).alias("_cut")))
    src = F.col(source_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       key(src.isNull(), F.coalesce(src.cast("string"), F.lit("")), F.col(id_col), whole).alias("_key"))
    # rows of one key are equal in every column, so any of them stands for all; the join goes on with the window's partitions
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_n = 1").drop("_n")
    text = F.col("_row").getField(text_col)
    begin = F.regexp_extract_all(text, F.concat(F.lit(rf"^(?:[{BLANK}]*+[^{BLANK}]++){{"), F.col("_words").cast("string"), F.lit("}+")), F.lit(0))
    new = F.when(F.col("_cut"), F.get(begin, 0)).otherwise(text)
    out = once.join(takes, "_key").select("_row", new.alias("_new"), "_cut", "_place", "_key", "_doc", "epoch")
    put = {text_col: F.col("_new")}
    if length_col in docs.columns:
        old = F.col("_row").getField(length_col)
        put[length_col] = F.when(F.col("_cut"), F.length("_new").cast(docs.schema[length_col].dataType)).otherwise(old)
    return out.orderBy("_place", "_doc", "epoch", "_key").select(*[put[c].alias(c) if c in put else F.col("_row").getField(c).alias(c) for c in docs.columns])

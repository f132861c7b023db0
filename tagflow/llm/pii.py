"""Information-theoretic sanitisation of personal data.

*Base.*  Patterns find the protected entities (email, ip, card, phone); failing matches are dropped, without retry.
*Disclosure.*  Over the whole corpus, with N documents, n(e) documents of entity e, n(t) documents that hold term t
and n(e, t) documents where t stands within ``window`` words of e:  PMI(e; t) = log2(N n(e,t) / (n(e) n(t))) says
how strongly t reveals e, and IC(e) = log2(N / n(e)) is all there is to reveal.  A term seen beside the entity in
``min_docs`` documents or more is removed when PMI >= IC (it stands in no other documents), and generalised to a
placeholder when PMI >= IC / ``alpha``.  The window is counted in words, however long they are or far apart.  ``detect`` marks the
term's occurrences within the window of that entity; ``sanitise`` redacts it wherever it stands in the documents that hold the entity.

The patterns run once over each text.  The words of a text that holds a match become rows with their places; words, matches and
their ends are sorted together, and running counts and maxima give each match its neighbours and each word the matches over it, so work
grows with words and matches (times a logarithm), never with their product.

Only DataFrame functions are used.  Spans are in code points, end exclusive.  Defined cases: null text counts as empty
and has no spans; null ids are kept; repeated rows count as documents each and get the same spans; overlapping
spans of different kinds are all reported, and redacted as one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import let, written

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns in Java's dialect.  (?:(?<!X)|\G) starts a run at its first character or behind the last match, and
#: possessive quantifiers keep long runs linear; neither changes what is found.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{M}'’]*+"
TERMS = "array<struct<start:bigint,end:bigint,removed:boolean>>"
#: Code points that a piece of a text is cut from, so that a cut doesn't walk from the text's start.
CHUNK = 1024


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
        d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (
            (q == "") | (F.when(F.length(q) <= 3, q).otherwise("0").try_cast("int") <= 255)))
        return F.forall(F.split(m, r"\."), part)
    n = F.length(digits_of(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits_of(m))).otherwise(False)
    return n.between(9, 15)


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, m), by the lengths of matches and gaps.

    The running sums are taken in blocks of the root of their number, so a text with very many matches stays cheap.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")

    def located(ms):
        gaps = F.split(text, pattern, -1)
        sizes = F.transform(F.arrays_zip(gaps.alias("g"), ms.alias("m")), lambda z: F.struct(
            F.length(F.coalesce(z["g"], F.lit(""))).cast("long").alias("g"), F.length(z["m"]).cast("long").alias("l"), z["m"].alias("m")))
        width = lambda a: a["g"] + F.coalesce(a["l"], F.lit(0).cast("long"))
        zero = F.lit(0).cast("long")

        def summed(z):
            step = F.ceil(F.sqrt(F.size(z).cast("double"))).cast("int")

            def with_blocks(b):
                blocks = F.transform(F.sequence(F.lit(0), F.size(z) - 1, b), lambda i: F.aggregate(F.slice(z, i + 1, b), zero, lambda a, x: a + width(x)))
                heads = lambda bs: F.transform(bs, lambda _, i: F.aggregate(F.slice(bs, F.lit(1), i), zero, lambda a, x: a + x))
                start = lambda h, x, i: (F.get(h, F.floor(i / b).cast("int")) + x["g"] + F.aggregate(
                    F.slice(z, (F.floor(i / b) * b + 1).cast("int"), i % b), zero, lambda a, y: a + width(y)))
                return let(blocks, lambda bs: let(heads(bs), lambda h: F.transform(z, lambda x, i: let(start(h, x, i), lambda s: F.struct(
                    s.alias("start"), (s + x["l"]).alias("end"), x["m"].alias("m"))))))

            return let(step, with_blocks)

        return F.filter(let(sizes, summed), lambda x: x["m"].isNotNull())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, located(ms)).otherwise(none))


def entities(text: Column) -> Column:
    """Valid base matches of one text: array of (start, kind, end, m), by start, then kind as listed."""
    t = F.coalesce(text, F.lit(""))
    first = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,m:string>>")

    def hits(k: int, kind: str) -> Column:
        own = F.transform(F.filter(found(t, PATTERNS[kind]), lambda x: valid(kind, x["m"])), lambda x: F.struct(
            x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))
        return F.when(first[kind], own).otherwise(none) if kind in first else own

    parts = [hits(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def words_at(mentions: DataFrame) -> DataFrame:
    """(row, k, start, end, m): the terms of each text in order, with their places."""
    size = lambda z: F.struct(F.length(F.coalesce(z["g"], F.lit(""))).cast("long").alias("g"), z["m"].alias("m"))
    pieces = F.transform(F.arrays_zip(F.split("text", TERM, -1).alias("g"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m")), size)
    each = mentions.select("row", F.posexplode(pieces).alias("k", "x"))
    end = F.sum(F.col("x.g") + F.coalesce(F.length("x.m"), F.lit(0))).over(Window.partitionBy("row").orderBy("k"))
    return each.select("row", F.col("k").cast("long").alias("k"), end.alias("end"), F.col("x.m").alias("m")).where(F.col("m").isNotNull()).select(
        "row", "k", (F.col("end") - F.length("m")).alias("start"), "end", "m")


def matches_at(mentions: DataFrame) -> DataFrame:
    """(row, j, start, end, e): the base matches of each text; e names the entity."""
    each = mentions.select("row", F.posexplode("base").alias("j", "b"))
    return each.select("row", "j", "b.start", "b.end", F.xxhash64("b.kind", F.lower("b.m")).alias("e"))


def clear_of(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows of ``spans`` (row, start, end, ...) that no base match overlaps: among matches that begin before a span's end, none ends behind its start."""
    both = spans.withColumn("_at", F.col("end")).withColumn("_base", F.lit(0)).unionByName(
        matches.select("row", F.col("start").alias("_at"), F.lit(1).alias("_base"), F.col("end").alias("_until")), allowMissingColumns=True)
    over = F.max("_until").over(Window.partitionBy("row").orderBy("_at", "_base").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_over", over).where((F.col("_base") == 0) & F.coalesce(F.col("_over") <= F.col("start"), F.lit(True))).select(*spans.columns)


def beside(words: DataFrame, matches: DataFrame, window: int) -> DataFrame:
    """(row, e, t, start, end): the terms within ``window`` words of each base match, as they stand in the text before and behind it.

    A word that a match cuts counts with its part on that side; words inside other matches count, and are left out afterwards.
    """
    tick = lambda at, side: matches.select("row", F.col(at).alias("at"), F.lit(0).alias("is_word"), "j", F.lit(side).alias("side"))
    events = words.select("row", F.col("start").alias("at"), F.lit(1).alias("is_word"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("int").alias("side"))
    events = events.unionByName(tick("start", 0)).unionByName(tick("end", 1))
    before = F.sum("is_word").over(Window.partitionBy("row").orderBy("at", "is_word").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = events.withColumn("n", before).where("is_word = 0")  # n words begin before this place
    reach = F.when(F.col("side") == 0, F.sequence(F.col("n") - window, F.col("n") - 1)).otherwise(F.sequence(F.col("n") - 1, F.col("n") + window - 1))
    asked = counted.select("row", "j", "side", "n", F.explode(reach).alias("k")).join(
        matches.select("row", "j", "e", F.col("start").alias("lo"), F.col("end").alias("hi")), ["row", "j"])
    met = asked.join(words, ["row", "k"])
    left, spans_end = F.col("side") == 0, (F.col("side") == 1) & (F.col("k") == F.col("n") - 1)
    part = (F.when(left & (F.col("end") > F.col("lo")), F.substring("m", F.lit(1), (F.col("lo") - F.col("start")).cast("int")))
            .when(spans_end & (F.col("end") <= F.col("hi")), "")
            .when(spans_end, F.regexp_extract(F.substring("m", (F.col("hi") - F.col("start") + 1).cast("int"), F.length("m")), TERM, 0)).otherwise(F.col("m")))
    cut = met.withColumn("part", part).where("part <> ''").select(
        "row", "j", "side", "e", "part", F.when(left, F.col("start")).otherwise(F.col("end") - F.length("part")).alias("start"))
    cut = cut.withColumn("end", F.col("start") + F.length("part"))
    place = F.row_number().over(Window.partitionBy("row", "j", "side").orderBy("start"))  # at most window + 1 rows
    near = cut.withColumn("place", place).where((F.col("side") == 0) | (F.col("place") <= window))
    return clear_of(near.select("row", "e", F.xxhash64(F.lower("part")).alias("t"), "start", "end"), matches)


def term_hashes(text: Column) -> Column:
    """Distinct term hashes of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))


def revealing(docs: DataFrame, near: DataFrame, matches: DataFrame, alpha: float, min_docs: int, text_col: str) -> DataFrame:
    """(e, t, removed): the pairs of entity and term that disclose too much."""
    n = docs.count()
    pairs = near.select("row", "e", "t").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= min_docs)
    pairs = written(pairs, "pii-pairs")
    n_e = matches.select("row", "e").distinct().groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    n_t = (docs.select(F.explode(term_hashes(F.col(text_col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
           .join(pairs.select("t").distinct(), "t", "left_semi"))
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    told = pairs.join(n_t, "t").join(n_e, "e")
    eps = 1e-9
    return told.where((ic > 0) & (pmi + eps >= ic / alpha)).select("e", "t", (pmi + eps >= ic).alias("removed"))


def listed(spans: DataFrame) -> DataFrame:
    """(row, terms) from spans (row, start, end, removed); a place that stands twice is removed if one of them is."""
    each = spans.groupBy("row", "start", "end").agg(F.max("removed").alias("removed"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))


def detect(docs: DataFrame, window: int = 5, alpha: float = 1.5, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (start, kind, end, m) and terms (start, end, removed), both by start."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), entities(F.col(text_col)).alias("base"))
    # only texts with a match are kept: later steps work on their words
    table = written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-matches")
    mentions = table.where(F.size("base") > 0)
    matches = matches_at(mentions)
    near = written(beside(words_at(mentions), matches, window), "pii-near")
    terms = listed(near.join(revealing(docs, near, matches, alpha, min_docs, text_col), ["e", "t"]).select("row", "start", "end", "removed"))
    none = F.array().cast(TERMS)
    marked = mentions.select("row", "doc_id", "base").join(terms, "row", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))
    return table.where(F.size("base") == 0).select("doc_id", "base", none.alias("terms")).unionByName(marked)


def cut_out(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text given as pieces of ``CHUNK`` code points."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def redacted(text: Column, base: Column, terms: Column) -> Column:
    """The text with base matches replaced by <KIND>, terms by <TERM> or nothing."""
    marks = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(
            F.lit("<"), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), b["kind"] + 1)), F.lit(">")).alias("by"))),
        F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["removed"], "").otherwise("<TERM>").alias("by")))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,by:string>>")

    def merge(acc, x):  # overlapping spans become one, under the first one's mark
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["by"].alias("by"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] < last["end"], longer).otherwise(F.concat(acc, F.array(x)))

    def merged(m):
        overlap = F.exists(F.sequence(F.lit(1), F.size(m)), lambda i: F.get(m, i)["start"] < F.get(m, i - 1)["end"])
        return F.when(F.coalesce(overlap, F.lit(False)), F.aggregate(m, empty, merge)).otherwise(m)

    def build(m):
        gap = lambda c, x, i: F.concat(cut_out(c, F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0).cast("long")), x["start"]), x["by"])
        whole = lambda c: F.concat(F.array_join(F.transform(m, lambda x, i: gap(c, x, i)), ""),
                                   cut_out(c, F.element_at(m, -1)["end"], F.length(text).cast("long")))
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), whole)

    return F.when(F.size(marks) == 0, text).otherwise(let(let(marks, merged), build))


def sanitise(docs: DataFrame, window: int = 5, alpha: float = 1.5, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text",
             length_col: str | None = "n_chars") -> DataFrame:
    """The documents, same columns, with redacted texts (and ``length_col`` set to the new length).

    Documents without a base match pass unmoved; only those with one are joined to the terms.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # the documents are written with their matches, so the patterns run once
    table = written(docs.select(whole, F.coalesce(F.col(text_col), F.lit("")).alias("text"), entities(F.col(text_col)).alias("base")).select(
        F.monotonically_increasing_id().alias("row"), "_row", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-documents")
    mentions = table.where(F.size("base") > 0).select("row", "base", "text")
    matches, words = matches_at(mentions), written(words_at(mentions), "pii-words")
    near = written(beside(words, matches, window), "pii-near")
    told = written(revealing(docs, near, matches, alpha, min_docs, text_col), "pii-told")
    close = near.join(told, ["e", "t"]).select("row", "start", "end", "removed")
    # a revealing term goes from the whole of each document that holds its entity
    held = matches.select("row", "e").distinct().join(told, "e").groupBy("row", "t").agg(F.max("removed").alias("removed"))
    far = words.select("row", "start", "end", F.xxhash64(F.lower("m")).alias("t")).join(held, ["row", "t"]).select("row", "start", "end", "removed")
    terms = listed(close.unionByName(clear_of(far, matches)))
    own = table.where(F.size("base") > 0).join(terms, "row", "left").select(
        "_row", redacted(F.col("text"), F.col("base"), F.coalesce("terms", F.array().cast(TERMS))).alias("_new"))
    put = {text_col: F.col("_new")} | ({length_col: F.length("_new").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return table.where(F.size("base") == 0).select("_row.*").unionByName(
        own.select(*[put[c].alias(c) if c in put else F.col("_row").getField(c).alias(c) for c in docs.columns]))

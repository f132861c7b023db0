"""Quality rules as weak supervision.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0).  A rule that looks for one fault
abstains where the fault is missing, as that says nothing about other faults.  The documents' vote patterns are
counted (at most 3 to the power of the rules, whatever the corpus size); expectation-maximisation over the
counted patterns estimates each rule's accuracy (how often a vote of it is right) and the share of good documents;
the posterior probability of being good replaces the all-must-pass filter.

Only DataFrame functions are used; the expectation-maximisation is a fold over the pattern counts.
Defined cases: null and empty texts have zero counts, fail the base rule and are not kept; ties (posterior
exactly at the threshold) are kept; repeated rows vote each; an empty table gives no rows and the prior
model; columns other than id and text are passed through (``filter_quality``) or ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import BLANK, BLANKS, let, words_of, written

#: Frequent function words of English, German, French and Spanish (fixed values, public stop-word lists).
FUNCTION_WORDS = (
    "the of and to a in is that it for on was with as be by this are from or an at which not but have "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son "
    "el los del las por con no una su para lo como más o pero sus le ya este sí porque esta entre").split()

#: Characters that count as symbols, and the smallest document (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_function",
          "n_shouts", "n_long"]

#: rule -> (condition of a good vote, condition of a bad vote); whole numbers only, so both engines agree.
RULES: dict[str, tuple[str, str]] = {
    "function_words": ("100 * n_function >= 12 * n_words", "100 * n_function < 6 * n_words"),
    "mean_word": ("false", "10 * word_chars < 25 * n_words or word_chars > 12 * n_words"),
    "symbols": ("false", "100 * n_symbols > 10 * n_words"),
    "dup_lines": ("false", "n_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    "repeats": ("false", "100 * n_repeat_words > 30 * n_words"),
    "upper": ("false", "100 * n_upper > 30 * word_chars"),
    "shouts": ("false", "100 * n_shouts > 10 * n_words"),
    "long_words": ("false", "100 * n_long > 10 * n_words"),
}
ROUNDS, FIRST, PRIOR, LOW, HIGH, PSEUDO = 40, 0.8, 0.7, 0.55, 0.99, 2.0
BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words inside ``n``-word windows that are found twice or more among ``words``."""
    last = F.size(words) - n

    def covered(g):
        order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def marked(s):
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(at, lambda k: F.get(s, k)["p"]))

        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p + n - a["end"])).alias("n"), (p + n).alias("end"))
        return let(order, lambda s: F.aggregate(marked(s), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"])

    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
    return F.when(last < 1, 0).otherwise(some)


def counts(text: Column) -> Column:
    """The counts of one text as a struct of longs (``COUNTS``)."""
    t = F.coalesce(text, F.lit(""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    of_words = lambda w: [
        F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).alias("n_function"),
        F.size(F.filter(w, lambda x: F.length(x) > 25)).alias("n_long")]
    both = F.struct(let(words_of(t), lambda w: F.struct(*of_words(w))).alias("w"),
                    let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"))
    made = lambda x: {
        "n_lines": x["l"]["n"], "n_dup_lines": x["l"]["dup"], "n_upper": upper,
        "n_shouts": F.regexp_count(t, F.lit(rf"!(?![^{BLANK}])")), "word_chars": F.length(F.translate(t, BLANKS, "")), "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        **{c: x["w"][c] for c in ("n_words", "n_repeat_words", "n_function", "n_long")}}
    return let(both, lambda x: F.struct(*[made(x)[c].cast("long").alias(c) for c in COUNTS]))


def vote(rule: str) -> Column:
    good, bad = RULES[rule]
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit(votes: DataFrame, rules: list[str]) -> dict[str, float]:
    """EM over a table with one vote column for each rule: {prior, <rule>: accuracy}.

    An accuracy is the expected share of right votes among the rule's votes, smoothed by PSEUDO votes of
    accuracy FIRST and kept within [LOW, HIGH], so that the two classes can't swap.
    """
    patterns = votes.groupBy(*rules).agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = patterns.agg(F.array_sort(F.collect_list(F.struct(F.array(*rules).alias("v"), "n"))).alias("p"))  # at most 3 ** rules
    places = F.sequence(F.lit(0), F.lit(len(rules) - 1))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(FIRST), len(rules)).alias("acc"))

    def good(s, x):
        odds = lambda j: F.get(x["v"], j) * F.log(F.get(s["acc"], j) / (1 - F.get(s["acc"], j)))
        return 1 / (1 + F.exp(-F.aggregate(places, F.log(s["prior"] / (1 - s["prior"])), lambda a, j: a + odds(j))))

    def step(s, _):
        soft = F.transform(F.col("p"), lambda x: F.struct(x["v"].alias("v"), (x["n"] * good(s, x)).alias("g"), x["n"].alias("n")))
        total = lambda q, of: F.aggregate(q, F.lit(0.0), lambda a, x: a + of(x))
        right = lambda j: lambda x: F.when(F.get(x["v"], j) == 1, x["g"]).when(F.get(x["v"], j) == -1, x["n"] - x["g"]).otherwise(0.0)
        cast = lambda j: lambda x: F.when(F.get(x["v"], j) == 0, 0.0).otherwise(x["n"])
        rate = lambda q, j: (total(q, right(j)) + PSEUDO * FIRST) / (total(q, cast(j)) + PSEUDO)
        return let(soft, lambda q: F.struct(
            ((total(q, lambda x: x["g"]) + PSEUDO * PRIOR) / (total(q, lambda x: x["n"]) + PSEUDO)).alias("prior"),
            F.transform(places, lambda j: F.least(F.greatest(rate(q, j), F.lit(LOW)), F.lit(HIGH))).alias("acc")))

    fitted = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("s")).first()[0]
    return {"prior": fitted["prior"], **dict(zip(rules, fitted["acc"]))}


def posterior(model: dict[str, float], rules: list[str]) -> Column:
    """Posterior probability of being good, from vote columns named as the rules."""
    logit = F.lit(log(model["prior"] / (1 - model["prior"])))
    for r in rules:
        logit = logit + F.col(r) * F.lit(log(model[r] / (1 - model[r])))
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, votes, base_failed, quality (posterior) and kept."""
    rules = list(RULES)
    counted = docs.select(F.col(id_col).alias("doc_id"), counts(F.col(text_col)).alias("_c")).select("doc_id", "_c.*")
    votes = written(counted.select("*", *[vote(r).alias(r) for r in rules]), "quality-votes")
    model = fit(votes, rules)
    return (votes.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", posterior(model, rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def filter_quality(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents (all columns) whose verdict is kept; votes are fitted on all documents, then voted again in place."""
    rules = list(RULES)
    count = counts(F.col(text_col))
    voted = lambda c: c.select("*", *[vote(r).alias(r) for r in rules])
    model = fit(voted(docs.select(count.alias("_c")).select("_c.*")), rules)
    row = "_quality_row"  # the input's columns stay in a struct of their own, so no name can clash
    kept = voted(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), count.alias("_c")).select(row, "_c.*"))
    return (kept.where(~F.expr(BASE_FAILED) & (posterior(model, rules) >= threshold))
            .select(f"{row}.*"))


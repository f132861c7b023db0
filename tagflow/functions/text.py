"""Column expressions for text normalisation and word/punctuation tokenisation.

All of them are JVM-side regular-expression functions, so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# The normaliser inserts one space after each of these marks:  . , ) ( [ ] { } ' ‟ -
# then collapses runs of U+0020 (only that character) into one.
MARK_CLASS = r"([.,)(\[\]{}\x27‟-])"
# Word/punctuation tokeniser: runs of word characters, or runs of characters
# that are neither word characters nor whitespace (Unicode semantics).  The
# classes are spelled out so Java regex and RE2 agree with Unicode \w / \s.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
# ---------------------------------------------------------------------------

# tokenise(normalise(x)) in one pass.  The normaliser only inserts a space
# after a mark, and the tokeniser ignores whitespace, so the composition equals
# "word runs, or punctuation runs that end at the first mark".  Spark evaluates
# one regex instead of rewriting the whole text twice first.
_MARKS = r".,)(\[\]{}\x27‟-"
_PUNCT_NO_MARK = r"[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}" + _MARKS + "]"
FUSED_TOKEN_PATTERN = (r"[\p{L}\p{N}_]+|" + _PUNCT_NO_MARK + "*[" + _MARKS + "]|" + _PUNCT_NO_MARK + "+")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text: Column | str) -> Column:
    """Space after each listed mark, then collapse runs of spaces (no trim)."""
    spaced = F.regexp_replace(_c(text), MARK_CLASS, "$1 ")
    return F.regexp_replace(spaced, " +", " ")


def tokenise(text: Column | str) -> Column:
    """Split into word runs and punctuation runs, order kept; whitespace dropped."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), F.lit(0))


def word_tokens(text: Column | str, max_len: int | None = None) -> Column:
    """tokenise(normalise(text)) (fused, one regex) -> optional cut to ``max_len`` tokens."""
    toks = F.regexp_extract_all(_c(text), F.lit(FUSED_TOKEN_PATTERN), F.lit(0))
    if max_len is not None:
        toks = F.slice(toks, 1, int(max_len))
    return toks


def whitespace_words(text: Column | str) -> Column:
    """Maximal runs without space or newline (used by the span fixtures).

    Same as splitting on ``[ \n]+`` and dropping empty strings, without a lambda.
    """
    return F.regexp_extract_all(_c(text), F.lit("[^ \n]+"), F.lit(0))


# SQL texts of the same expressions for DuckDB oracles ({x} is the argument).
DUCK_NORMALISE = r"regexp_replace(regexp_replace({x}, '([.,)(\[\]{{}}\x27‟-])', '\1 ', 'g'), ' +', ' ', 'g')"
DUCK_TOKENISE = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')"


def duck_word_tokens(x: str) -> str:
    return DUCK_TOKENISE.format(x=DUCK_NORMALISE.format(x=x))


# ---------------------------------------------------------------- basic words (before subwords)
#: Control, format and private characters but tab and line ends, the replacement character; CJK ideographs; marks (ASCII ranges
#: and Unicode punctuation).  Written so that Java and RE2 read them alike.
CONTROL_PATTERN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\p{Cf}\p{Co}]"
CJK_RANGES = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
MARKS = r"!-/:-@\[-`{-~\p{P}"
BASIC_PATTERN = rf"[^\s\p{{Z}}{MARKS}{CJK_RANGES}]+|[{MARKS}{CJK_RANGES}]"


def basic_words(text) -> Column:
    """Basic words of a text: control characters removed, lower-cased, split at white space, every mark and every CJK character a word of its own."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, CONTROL_PATTERN, "")), F.lit(BASIC_PATTERN), F.lit(0))

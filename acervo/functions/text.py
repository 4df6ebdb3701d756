"""Text expressions: normalisation, predicates, headings, tokens, sanitising.

Everything here stays in the JVM except Unicode composition (NFC), for which
Spark has no built-in; that one runs as a pandas function and only sees the
strings that can change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Unicode White_Space, and the set that trimming and tokenising use
# (White_Space without U+0085, with the byte order mark).
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BOM, PARAGRAPH_BREAK = chr(0xFEFF), chr(0x2029)
TRIM_SET = WHITE_SPACE.replace(chr(0x85), "") + BOM
SPACE_CLASS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Headings: at most this many characters and words, and no closing punctuation.
MAX_HEADING_CHARACTERS = 80
MAX_HEADING_WORDS = 10
# Least number of extractable characters in a version.
MIN_EXTRACTED_CHARACTERS = 20
# Word separators and the words a question does not need to match on.
TOKEN_SEPARATORS = ",¿?¡!.;:()"
STOP_WORDS = (
    "el", "la", "los", "las", "un", "una", "de", "del", "en", "y", "e", "o", "u", "a", "ante", "bajo", "con",
    "contra", "para", "por", "que", "cual", "como", "cuando", "donde", "es", "se", "su", "lo", "qué", "cuál",
    "cómo", "cuándo", "dónde", "al", "no",
)
# ----------------------------------------------------------------------------

_NOISE = r"[\p{Cc}\p{Cf}&&[^\p{IsWhite_Space}]]"
_HORIZONTAL = r"[\p{IsWhite_Space}&&[^\n]]+"
# What keeps a string from normal line structure, apart from white space at its
# start: noise, white space other than space and line feed, runs, and ends.
_UNSETTLED = (
    r"[\p{Cc}\p{Cf}\p{IsWhite_Space}]"
    r"(?:(?<![ \n])|(?<= )(?=[ \n]|\z)|(?<=\n)(?= |\n\n|\z))"
)
# Every code point below U+0300 is stable under NFC.
COMPOSABLE = r"[^\x{0}-\x{2FF}]"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _nfc_of(source: Column, result: Column) -> Column:
    """NFC of ``result``, which holds no code point that ``source`` lacks.

    The test reads ``source``, so ``result`` is computed once per row: in the
    call for the few strings that can change, in the fallback for all others.
    """
    return F.coalesce(_compose(F.when(source.rlike(COMPOSABLE), result)), result)


def nfc(col: Column) -> Column:
    """Unicode NFC. Only strings that may change travel to Python."""
    return _nfc_of(col, col)


def settle_text(col: Column) -> Column:
    """Line structure and white space of ``normalize_text``, before composition."""
    step = F.replace(col, F.lit(BOM), F.lit(""))
    step = F.regexp_replace(step, r"\r\n?|\x{85}|\x{2028}", "\n")
    step = F.replace(step, F.lit(PARAGRAPH_BREAK), F.lit("\n\n"))
    step = F.regexp_replace(step, _NOISE, "")
    step = F.regexp_replace(step, _HORIZONTAL, " ")
    step = F.regexp_replace(step, r" ?\n ?", "\n")
    step = F.regexp_replace(step, r"\n{3,}", "\n\n")
    unsettled = col.startswith(" ") | col.startswith("\n") | col.rlike(_UNSETTLED)
    return F.when(unsettled, F.trim(step, F.lit(" \n"))).otherwise(col)


def normalize_text(col: Column) -> Column:
    """Canonical page text: one line structure, single spaces, no control noise, NFC."""
    return _nfc_of(col, settle_text(col))


def extractable_chars(col: Column) -> Column:
    """Number of code points that are not white space, control or format."""
    return F.length(F.regexp_replace(col, r"[\p{IsWhite_Space}\p{Cc}\p{Cf}]+", ""))


def has_extractable_chars(col: Column, least: int) -> Column:
    """Whether ``extractable_chars`` is ``least`` or more; reads no further than these."""
    return col.rlike(rf"\A(?:[\p{{IsWhite_Space}}\p{{Cc}}\p{{Cf}}]*+[^\p{{IsWhite_Space}}\p{{Cc}}\p{{Cf}}]){{{least}}}")


def has_extractable_text(col: Column) -> Column:
    return col.rlike(r"[^\p{IsWhite_Space}\p{Cc}\p{Cf}]")


def trimmed(col: Column) -> Column:
    return F.trim(col, F.lit(TRIM_SET))


def canonical_text(col: Column, least: int, most: int) -> Column:
    """Trimmed NFC text of bounded length without control or format characters, else null."""
    text = _nfc_of(col, trimmed(col))
    return F.when(
        F.length(text).between(least, most) & ~text.rlike(r"[\p{Cc}\p{Cf}]"), text
    )


def is_heading(line: Column) -> Column:
    """A short, all upper-case line that does not end like a sentence.

    The first test follows from the third; it turns most lines away at once.
    """
    return (
        ~line.rlike("[a-z]")
        & (F.length(line) <= MAX_HEADING_CHARACTERS)
        & (line == F.upper(line))
        & (line != F.lower(line))
        & line.rlike(r"\p{L}")
        & (F.size(F.split(line, f"[{SPACE_CLASS}]+")) <= MAX_HEADING_WORDS)
        & ~line.rlike(r"[.!?;,:]\z")
    )


def may_hold_heading(text: Column) -> Column:
    """False only for texts without any heading line; one look at the whole text."""
    return text.rlike(f"(?m)^[^a-z\\n]{{1,{MAX_HEADING_CHARACTERS}}}$")


def excerpt(col: Column, most: int = 300) -> Column:
    return F.substring(col, 1, most)


def sanitize_code(col: Column) -> Column:
    code = F.substring(F.regexp_replace(col, "[^A-Z0-9_]", "_"), 1, 100)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("UNKNOWN_ERROR"))


def sanitize_message(col: Column) -> Column:
    return F.substring(trimmed(F.regexp_replace(col, r"[\x00-\x1F\x7F]", " ")), 1, 500)


def strip_trailing_punct(col: Column) -> Column:
    return F.regexp_replace(col, r"""[.,;:!?"')\]}>]+\z""", "")


def tokenize(col: Column) -> Column:
    """Lower-case words, split on white space and sentence punctuation."""
    words = F.split(F.lower(col), f"[{SPACE_CLASS}{TOKEN_SEPARATORS}]+")
    return F.filter(words, lambda w: w != "")


def split_words(col: Column) -> Column:
    """The words of ``tokenize`` among empty ones; a split at one plain character needs no regular expression."""
    separators = TRIM_SET + TOKEN_SEPARATORS
    return F.split(F.translate(F.lower(col), separators, " " * len(separators)), " ")


def content_words(col: Column) -> Column:
    """Words of a question that carry content; repeats are kept."""
    return F.filter(
        tokenize(col), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)
    )

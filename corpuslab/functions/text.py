"""Text column functions.

Every function maps Columns to a Column built from Spark built-ins, so it stays inside whole-stage
codegen. The one exception is NFC normalization, which Spark lacks: it runs as an Arrow pandas UDF
and is fed only the rows that can change (others reach Python as nulls).
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpuslab.functions import constants as K

NON_LETTER = r"\P{L}++"
# Text whose code points are all below U+0300 is already NFC (no combining marks, no singletons,
# no Hangul), so only rows with a later code point go through the UDF.
MAY_CHANGE_UNDER_NFC = r"[^\x{0}-\x{2ff}]"


# Characters that Python's ``str.strip()``/``isspace()`` treat as white space: Unicode White_Space
# plus the ASCII separators U+001C..U+001F, for ``trim`` (a character-set trim, no regex).
PY_SPACE_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.trim(c, F.lit(PY_SPACE_CHARS))


def letter_count(c: Column) -> Column:
    """Number of code points in Unicode category L*."""
    return F.length(F.regexp_replace(c, NON_LETTER, ""))


def sha256_hex(c: Column) -> Column:
    """SHA-256 hex digest of the UTF-8 bytes."""
    return F.sha2(c, 256)


def _nfc_batch(s: pd.Series) -> pd.Series:
    """Null where nothing changes, so that only changed text travels back."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) and not unicodedata.is_normalized("NFC", x) else None)


# NFC is deterministic; the flag only stops Catalyst from pushing a filter on a verdict column
# through this projection, which would inline the whole regex chain into the filter once per use.
_nfc_udf = F.pandas_udf(_nfc_batch, ST.StringType()).asNondeterministic()


def nfc(c: Column) -> Column:
    """NFC normalization; only text that may change crosses to Python."""
    return F.coalesce(_nfc_udf(F.when(c.rlike(MAY_CHANGE_UNDER_NFC), c)), c)


def collapse_blanks(c: Column) -> Column:
    """Runs of spaces/tabs become one space."""
    # single spaces stay as they are, and most text has no others
    return F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r" [ \t]++|\t[ \t]*+", " ")).otherwise(c)


def collapse_newlines(c: Column) -> Column:
    """C4: three or more newlines become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def collapse_and_strip(c: Column) -> Column:
    """C3+C4+C5, of text in NFC."""
    return py_strip(collapse_newlines(collapse_blanks(c)))


def normalize_text(c: Column) -> Column:
    """C2+C3+C4+C5 in the reference's order."""
    return collapse_and_strip(nfc(c))


# Line terminators of Python's ``str.splitlines()`` as one class, and the white space that is not a terminator.
_TERM = r"[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_INLINE_SPACE = r"[\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_NOT_SPACE = r"[^\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The start of a line holding a non-space character. It is only tried where a line begins, so a long run of
# spaces is scanned once.
NONBLANK_LINE = rf"(?:\A|(?<={_TERM})){_INLINE_SPACE}*+{_NOT_SPACE}"


def _boilerplate_line_pattern(lines: list[str]) -> str:
    alts = "|".join(re.escape(x) for x in lines)
    return rf"(?:\A|(?<={_TERM})){_INLINE_SPACE}*(?:{alts}){_INLINE_SPACE}*(?={_TERM}|\z)"


BOILERPLATE_LINE = _boilerplate_line_pattern(K.BOILERPLATE_LINES)


def nonblank_line_count(t: Column) -> Column:
    """Number of lines of ``splitlines`` that are not blank, without materializing the lines."""
    return F.regexp_count(t, F.lit(NONBLANK_LINE))


def boilerplate_line_count(t: Column) -> Column:
    """Number of lines that, stripped and lower-cased, equal a boilerplate line."""
    def count(low):  # the lines are only looked at in a text that has one of the phrases
        some = reduce(or_, (low.contains(x) for x in K.BOILERPLATE_LINES))
        return F.when(~some, F.lit(0)).otherwise(F.regexp_count(low, F.lit(BOILERPLATE_LINE)))

    return F.transform(F.array(F.lower(t)), count)[0]  # a lambda's variable is computed once


def low_signal_reason(t: Column) -> Column:
    """F4-F8 on already stripped text: the first failing rule's name, or null when it passes.

    The CASE is evaluated in order, so the byte length (cheap) is tested before the letter scan
    and the line scans. Lines are counted by regex over the whole text rather than split into an
    array and mapped with a lambda (higher-order functions run interpreted, outside codegen).
    """
    nb = F.octet_length(t)
    nc = F.length(t)
    n_boiler = boilerplate_line_count(t)
    return (
        F.when(nb < K.MIN_CONTENT_BYTES, F.lit("too_short"))
        .when((nc > 0) & ((F.lit(1.0) - letter_count(t) / nc) > F.lit(K.MAX_NON_ALPHA_RATIO)),
              F.lit("non_alpha_ratio"))
        # stripped text that is not empty starts with a non-space character, so it has a
        # non-blank line: "no non-blank lines" is exactly "empty"
        .when(t == F.lit(""), F.lit("empty_after_strip"))
        # lines are only counted when a boilerplate line exists (AND short-circuits)
        .when((n_boiler > 0) & ((n_boiler / nonblank_line_count(t)) > F.lit(K.MAX_BOILERPLATE_RATIO)),
              F.lit("boilerplate"))
    )


def valid_utf8(c: Column) -> Column:
    """Replace invalid UTF-8 sequences the way a lenient decoder does."""
    return F.make_valid_utf8(c)

"""Tokenising and typed parsing of combat-log text.

A log line is ``M/d HH:mm:ss.SSS`` + two spaces + comma separated tokens.
Everything here is a built-in Column expression (linear in the line length,
no look-ahead regex, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Between a line's header and its body.
SEPARATOR = "  "
# Placeholders used while splitting; neither occurs in log text.
_COMMA_IN_QUOTES = "\u0001"
_ESCAPED_QUOTE = "\u0002"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_header(value: Column | str, parity: bool = False) -> tuple[Column, Column]:
    """(timestamp text, body). The body is everything after the first
    double space; with ``parity=True`` it is cut at a second double space
    (the reference keeps only the second piece). No separator -> body NULL."""
    v = _c(value)
    pos = F.instr(v, SEPARATOR)
    header = F.when(pos > 0, F.substring(v, F.lit(1), pos - 1))
    if parity:
        parts = F.split(v, SEPARATOR)
        body = F.when(pos > 0, F.get(parts, 1))
    else:
        body = F.when(pos > 0, F.substring(v, pos + 2, F.lit(2147483647)))
    return header, body


# An opening quote (odd-numbered) followed by a comma before its closing
# quote. The runs between quotes are matched possessively, so backtracking
# only steps over whole quote pairs: the match is linear in the line length.
_COMMA_INSIDE_QUOTES = r'^[^"]*+(?:"[^"]*+"[^"]*+)*"[^",]*+,'


def split_tokens(body: Column | str) -> Column:
    """Quote-aware comma split. Commas inside ``"..."`` stay in the token,
    quotes are kept, ``\\"`` does not toggle quoting, empty tokens are kept.

    Lines without a comma inside quotes (almost all) take a plain ``split``;
    the rest take the linear quote-aware form: split on quotes, protect the
    commas inside the odd (quoted) pieces, join back and split on commas.
    """
    b0 = _c(body)
    b = F.replace(b0, F.lit('\\"'), F.lit(_ESCAPED_QUOTE))
    pieces = F.split(b, '"', -1)
    guarded = F.transform(
        pieces, lambda x, i: F.when(i % 2 == 1, F.translate(x, ",", _COMMA_IN_QUOTES)).otherwise(x))
    rejoined = F.array_join(guarded, '"')
    toks = F.split(rejoined, ",", -1)
    quoted = F.transform(
        toks, lambda t: F.replace(F.translate(t, _COMMA_IN_QUOTES, ","), F.lit(_ESCAPED_QUOTE), F.lit('\\"')))
    needs_quotes = F.contains(b0, F.lit('\\"')) | b0.rlike(_COMMA_INSIDE_QUOTES)
    return F.when(needs_quotes, quoted).otherwise(F.split(b0, ",", -1))


def trim_one_quote(col: Column | str) -> Column:
    """Drop one trailing and one leading double quote."""
    return F.regexp_replace(_c(col), r'^"|"$', "")


def trim_all(col: Column | str, chars: str) -> Column:
    """Drop every leading and trailing character from ``chars``."""
    return F.btrim(_c(col), F.lit(chars))


_INT_TEXT = r"^[+-]?[0-9]+$"


def parse_int32(col: Column | str) -> Column:
    """Decimal text -> INT; anything else (spaces, fractions, overflow) -> NULL."""
    c = _c(col)
    return F.when(c.rlike(_INT_TEXT), c.try_cast("int"))


def parse_int64(col: Column | str) -> Column:
    """P5: decimal text -> BIGINT; anything else -> NULL."""
    c = _c(col)
    return F.when(c.rlike(_INT_TEXT), c.try_cast("bigint"))


def log_time_millis(ts_text: Column | str, year: Column | int) -> Column:
    """``M/d HH:mm:ss.SSS`` of the given year -> epoch milliseconds (UTC).
    Unparseable text -> NULL."""
    y = F.lit(year) if isinstance(year, int) else year
    full = F.concat(y.cast("string"), F.lit("/"), _c(ts_text))
    ts = F.try_to_timestamp(full, F.lit("yyyy/M/d HH:mm:ss.SSS"))
    return F.unix_millis(ts)

"""Spreadsheet coercions on Spark columns.

A value is a column with a kind: ``num`` (double), ``text`` (string), ``bool`` or ``cell`` (the string of a worksheet cell,
whose type shows only at run time: blank, TRUE/FALSE, number or text).  Every rule is a built-in expression, so it stays
in code generation and, where the column is a source column, can be pushed to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Error sentinels that ISERROR and IFERROR see.
ERROR = r"^#(?:N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!|NULL!)"
#: White space that trimming removes: ASCII blanks and controls, no-break space, Unicode blanks, byte order mark.
BLANKS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER = re.compile(rf"^(?:{DECIMAL}|[+-]?Infinity|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$")
EPOCH = "1899-12-30"


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str
    literal: object = None  # the Python value of a constant
    aggregate: bool = False


def lit(value: object) -> Val:
    if isinstance(value, bool):
        return Val(F.lit(value), "bool", value)
    if isinstance(value, (int, float)):
        return Val(F.lit(float(value)), "num", float(value))
    return Val(F.lit(value), "text", value)


def of(col: Column, kind: T.DataType) -> Val:
    """A DataFrame column as a value: numbers, booleans, dates (as serials) and cell texts."""
    if isinstance(kind, T.BooleanType):
        return Val(col, "bool")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Val(serial_of(F.to_date(col)), "num")
    if isinstance(kind, T.NumericType):
        return Val(col.cast("double"), "num")
    return Val(col.cast("string"), "cell")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(c, ",", ""))


def is_number_text(c: Column) -> Column:
    """Whether a text counts as a number once commas and outer blanks are gone; an empty one does not."""
    p = _plain(c)
    return p.rlike(rf"^(?:{DECIMAL}|[+-]?Infinity|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$")


def text_to_num(c: Column) -> Column:
    """Blank text is 0, TRUE is 1, numbers (also 0x, 0o, 0b) their value, anything else 0."""
    p = _plain(c)
    based = lambda base: F.conv(F.substring(p, 3, 64), base, 10).cast("double")
    return (
        F.when(p.rlike(rf"^{DECIMAL}$"), p.try_cast("double"))
        .when(p.rlike("^0[xX][0-9a-fA-F]+$"), based(16)).when(p.rlike("^0[oO][0-7]+$"), based(8)).when(p.rlike("^0[bB][01]+$"), based(2))
        .when(p.rlike(r"^\+?Infinity$"), F.lit(float("inf"))).when(p == "-Infinity", F.lit(float("-inf")))
        .when(F.upper(c) == "TRUE", F.lit(1.0)).otherwise(F.lit(0.0))
    )


def num(v: Val) -> Column:
    if v.kind == "num":
        return F.coalesce(v.col, F.lit(0.0))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    return text_to_num(F.coalesce(v.col, F.lit("")))


def num_to_text(c: Column) -> Column:
    """A double as text: no trailing zeros, plain digits from 1e-6 up to 1e21, a lower-case exponent outside."""
    s = c.cast("string")
    whole = c.cast("decimal(38,0)").cast("string")
    small = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,26)").cast("string"), r"0+$", ""), r"\.$", "")
    large = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,10)").cast("string"), r"0+$", ""), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(\d)", "e+$1")
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").when(c == 0, "0")
        .when((size < 1e21) & (c == F.floor(c).cast("double")), whole)
        .when(size >= 1e21, power).when(size >= 1e7, large)
        .when(size >= 1e-3, s).when(size >= 1e-6, small).otherwise(F.regexp_replace(power, "E", "e"))
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word(v: Val) -> Column:
    """The text of a value that is known not to be a number."""
    if v.kind == "cell":
        c = F.coalesce(v.col, F.lit(""))
        return F.when(c.isin("TRUE", "FALSE"), F.lower(c)).otherwise(strip(c))
    return text(v)


def text(v: Val) -> Column:
    if v.kind == "num":
        return F.coalesce(num_to_text(v.col), F.lit(""))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("string"), F.lit(""))
    if v.kind == "cell":  # a cell's number loses its leading zeros, its text its outer blanks
        number = let(text_to_num(v.col), num_to_text)
        return F.when(is_number_text(F.coalesce(v.col, F.lit(""))), number).otherwise(word(v))
    return F.coalesce(v.col, F.lit(""))


def boolean(v: Val) -> Column:
    """Numbers by zero; TRUE and FALSE in any case; other text by being there."""
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce(v.col != 0, F.lit(False))
    t = word(v)
    out = F.when(t == "", F.lit(False)).when(F.upper(t) == "FALSE", F.lit(False)).otherwise(F.lit(True))
    if v.kind == "cell":
        return F.when(is_num(v), num(v) != 0).otherwise(out)
    return out


def is_num(v: Val) -> Column:
    """Whether the value is a number at run time."""
    if v.kind == "cell":
        return is_number_text(F.coalesce(v.col, F.lit("")))
    return F.lit(v.kind == "num")


def is_bool(v: Val) -> Column:
    if v.kind == "cell":
        return F.coalesce(v.col.isin("TRUE", "FALSE"), F.lit(False))
    return F.lit(v.kind == "bool")


def equal(a: Val, b: Val) -> Column:
    """Numbers if either side is one; then truth values; then text, case counting."""
    if "num" in (a.kind, b.kind):
        return num(a) == num(b)
    if "cell" in (a.kind, b.kind):
        cell, other = (a, b) if a.kind == "cell" else (b, a)
        if isinstance(other.literal, str):  # a constant text: its number is known, and no truth value equals it but by name
            n = to_number(other.literal)
            n = float(other.literal.upper() == "TRUE") if n is None else n
            same = strip(F.coalesce(cell.col, F.lit(""))) == other.literal
            truth = F.when(is_bool(cell), boolean(cell) == boolean(other))
            return F.when(is_num(cell), num(cell) == n).otherwise(F.coalesce(truth, same))
        rest = F.when(is_bool(a) | is_bool(b), boolean(a) == boolean(b)).otherwise(word(a) == word(b))
        return F.when(is_num(a) | is_num(b), num(a) == num(b)).otherwise(rest)
    if "bool" in (a.kind, b.kind):
        return boolean(a) == boolean(b)
    return text(a) == text(b)


def compare(a: Val, op: str, b: Val) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    ask = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if "num" in (a.kind, b.kind):
        return ask(num(a), num(b))
    words = ask(word(a), word(b))
    if "cell" in (a.kind, b.kind):
        return F.when(is_num(a) | is_num(b), ask(num(a), num(b))).otherwise(words)
    return words


def to_number(value: str) -> float | None:
    """A text as a number, None if it is none; blank is 0."""
    p = value.replace(",", "").strip(" \t\n\r\x0b\x0c ﻿　")
    if not p:
        return 0.0
    if not NUMBER.match(p):
        return None
    if p[:2].lower() in ("0x", "0o", "0b"):
        return float(int(p, 0))
    return float(p.replace("Infinity", "inf"))


def criteria(v: Val, wanted: object) -> Column:
    """``v`` against a criterion such as ``">5"``, ``"<>x"`` or a plain value.  With an operator and a number, blanks and
    texts count as 0; an operator alone compares with 0.  No wildcards."""
    t = wanted.strip() if isinstance(wanted, str) else ("TRUE" if wanted is True else "FALSE" if wanted is False else f"{wanted:.15g}")
    m = re.match(r"(?s)^(<=|>=|<>|=|<|>)(.*)$", t)
    if not m:
        n = to_number(t) if v.kind == "num" else None
        return equal(v, lit(n) if n is not None else lit(t))
    right = m[2].strip()
    n = to_number(right)
    a, b = (Val(num(v), "num"), lit(n)) if n is not None else (Val(text(v), "text"), lit(right))
    return compare(a, m[1], b)


def is_error(v: Val) -> Column:
    if v.kind in ("num", "bool"):
        return F.lit(False)
    return F.coalesce(v.col.rlike(ERROR), F.lit(False))


def serial_of(date: Column) -> Column:
    return F.datediff(date, F.lit(EPOCH).cast("date")).cast("double")


def date_of(serial: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial).cast("int"))


def date_text_serial(t: Column) -> Column:
    """Serial of ``Y/M/D`` (also with year, month and day signs, dots or hyphens), null for other text; days past the
    month's end run on."""
    s = F.regexp_replace(F.regexp_replace(strip(t), "[年/.\\-月]", "/"), "日", "")
    part = lambda i: F.regexp_extract(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", i).try_cast("int")
    return F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), make_serial(part(1), part(2), part(3)))


def make_serial(y: Column, m: Column, d: Column) -> Column:
    """Serial of year, month, day, overflow carried; years 0 to 99 are 1900 to 1999."""
    y = F.floor(y).cast("int")
    y = F.when((y >= 0) & (y <= 99), y + 1900).otherwise(y)
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), F.floor(m).cast("int") - 1)
    return serial_of(F.date_add(first, F.floor(d).cast("int") - 1))


def date_serial(v: Val) -> Column:
    if v.kind in ("num", "bool"):
        return num(v)
    return F.coalesce(date_text_serial(text(v)), num(v))

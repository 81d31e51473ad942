"""Cell addresses: ``B3``, 1-based rows and columns, ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDRESS = re.compile(r"^\$?([A-Za-z]+)\$?(\d+)$")


def letters(col: int) -> str:
    out = ""
    while col > 0:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(text: str) -> int:
    n = 0
    for c in text.upper():
        n = n * 26 + ord(c) - 64
    return n


def cell(address: str) -> tuple[int, int]:
    """(row, column); (0, 0) for what is no address."""
    m = _ADDRESS.match(address.strip())
    return (int(m[2]), column_number(m[1])) if m else (0, 0)


def name(row: int, col: int) -> str:
    return f"{letters(col)}{row}"


def rectangle(text: str) -> tuple[int, int, int, int] | None:
    """(first row, first column, last row, last column) of ``A1:C3`` or ``A1``, corners in any order."""
    parts = text.replace("$", "").split(":")
    a, b = cell(parts[0]), cell(parts[-1])
    if len(parts) > 2 or not all((*a, *b)):
        return None
    return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


def shown(r1: int, c1: int, r2: int, c2: int) -> str:
    """A range as reports show it: ``A1-C3``."""
    return f"{name(r1, c1)}-{name(r2, c2)}"


def letters_of(col: Column) -> Column:
    """Column letters of a number up to 18278 (three letters)."""
    c = col.cast("int")
    char = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    one, two = char(c - 1), F.concat(char(F.floor((c - 27) / 26).cast("int")), char(c - 1))
    three = F.concat(char(F.floor((c - 703) / 676).cast("int")), char(F.floor((c - 27) / 26).cast("int")), char(c - 1))
    return F.when(c < 1, "").when(c <= 26, one).when(c <= 702, two).otherwise(three)


def number_of(text: Column) -> Column:
    """Column number of letters; 0 for none."""
    up = F.upper(text)
    return F.aggregate(F.filter(F.split(up, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def split_address(text: Column) -> tuple[Column, Column]:
    """(row, column) of an address column; 0 and 0 for what is no address."""
    fine = text.rlike(r"^\$?[A-Za-z]+\$?\d+$")
    row = F.when(fine, F.regexp_extract(text, r"(\d+)$", 1).cast("int")).otherwise(0)
    return row, F.when(fine, number_of(F.regexp_extract(text, r"^\$?([A-Za-z]+)", 1))).otherwise(0)


def address_of(row: Column, col: Column) -> Column:
    return F.concat(letters_of(col), row.cast("string"))

"""Moving formulas: relative references shift, those with $ stay."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.address import column_number, letters

_REFERENCE = re.compile(r"((?:'(?:[^']|'')+'|[A-Za-z0-9_ ]+)!)?(\$?)([A-Z]+)(\$?)(\d+)", re.A)


def moved(formula: str, rows: int, cols: int) -> str:
    """The formula as it reads so many rows and columns further on; references stop at the first row and column."""

    def place(m: re.Match) -> str:
        col = m[3] if m[2] else letters(max(1, column_number(m[3]) + cols))
        row = int(m[5]) if m[4] else max(1, int(m[5]) + rows)
        return f"{m[1] or ''}{m[2]}{col}{m[4]}{row}"

    return "=" + _REFERENCE.sub(place, formula.removeprefix("="))


def shift(formula: Column, rows: Column, cols: Column) -> Column:
    @F.pandas_udf("string")
    def run(f: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(a) or pd.isna(b) else moved(x, int(a), int(b)) for x, a, b in zip(f, r, c, strict=True)], dtype=object)

    return run(formula, rows, cols)

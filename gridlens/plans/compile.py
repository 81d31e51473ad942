"""Formulas over the columns of a DataFrame, compiled to Spark expressions.

``[column]`` names and ``Table[column]`` references are columns; everything else is the formula language.  A formula
without aggregate functions is a projection; one with them is an aggregation of a group.  Catalyst sees built-in
expressions only: it folds constants, prunes columns and pushes filters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.coerce import Val, num, text
from ..functions.library import AGGREGATES, SCALARS, Unsupported
from .lexer import FormulaError
from .parser import Array, Binary, Call, Cell, ErrorValue, Literal, Name, Postfix, Range, Structured, Unary, parse

_BARE = re.compile(r"(?<![\w\]])\[([^\[\]]+)\]")


class Compiler:
    def __init__(self, df: DataFrame):
        self.kinds = {f.name: f.dataType for f in df.schema.fields}
        self.lower = {n.lower(): n for n in self.kinds}

    def column(self, name: str) -> Val:
        found = self.lower.get(name.lower())
        if found is None:
            raise FormulaError(f"there is no column {name}")
        return coerce.of(F.col(f"`{found}`"), self.kinds[found])

    def value(self, node) -> Val:
        match node:
            case Literal(value=v):
                return coerce.lit(v)
            case ErrorValue(code=c):
                return coerce.lit(c)
            case Structured(column=c, qualifier=None):
                return self.column(c)
            case Name(name=n, sheet=None):
                return self.column(n)
            case Unary(op=op, operand=x):
                v = self.value(x)
                if op == "-" and isinstance(v.literal, float):
                    return coerce.lit(-v.literal)
                return Val(-num(v) if op == "-" else num(v), "num", aggregate=v.aggregate)
            case Postfix(op="%", operand=x):
                v = self.value(x)
                return Val(num(v) / 100, "num", aggregate=v.aggregate)
            case Binary(op=op, left=a, right=b) if op != " ":
                return self.binary(op, self.value(a), self.value(b))
            case Call(name=f, args=args):
                return self.call(f, args)
            case Array() | Cell() | Range():
                raise FormulaError("cells and arrays belong to workbooks; columns are written [name]")
        raise FormulaError(f"cannot be compiled: {node}")

    def binary(self, op: str, a: Val, b: Val) -> Val:
        agg = a.aggregate or b.aggregate
        if op == "&":
            return Val(F.concat(text(a), text(b)), "text", aggregate=agg)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return Val(coerce.compare(a, op, b), "bool", aggregate=agg)
        x, y = num(a), num(b)
        if op == "/":  # by zero: Infinity, or NaN for 0 / 0
            by_zero = F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return Val(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)), "num", aggregate=agg)
        return Val({"+": x + y, "-": x - y, "*": x * y}[op], "num", aggregate=agg)

    def call(self, name: str, args) -> Val:
        values = [self.value(a) for a in args]
        inner = any(v.aggregate for v in values)
        if name in AGGREGATES and not inner:
            out = AGGREGATES[name](values)
            return Val(out.col, out.kind, aggregate=True)
        if name in SCALARS:
            try:
                out = SCALARS[name](values)
            except (IndexError, TypeError) as e:
                raise FormulaError(f"{name} does not take {len(values)} arguments") from e
            return Val(out.col, out.kind, out.literal, inner)
        raise Unsupported(f"{name} over columns")


def compiled(df: DataFrame, formula: str) -> Val:
    """A formula over the columns of df, for instance ``=SUMIFS([price],[flag],"R")``."""
    return Compiler(df).value(parse(_BARE.sub(lambda m: f"_[{_quoted(m[1])}]", formula)))


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[^\W\d][\w.]*", name) else "'" + name.replace("'", "''") + "'"


def column(df: DataFrame, formula: str) -> Column:
    return compiled(df, formula).col


def project(df: DataFrame, **formulas: str) -> DataFrame:
    """df with a column for each formula."""
    return df.withColumns({n: column(df, f) for n, f in formulas.items()})


def where(df: DataFrame, formula: str) -> DataFrame:
    return df.where(coerce.boolean(compiled(df, formula)))


def aggregate(df: DataFrame, by: Sequence[str], **formulas: str) -> DataFrame:
    """A row for each group with the value of each aggregate formula: one shuffle of partial sums."""
    return df.groupBy(*by).agg(*[column(df, f).alias(n) for n, f in formulas.items()])

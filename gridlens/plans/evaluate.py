"""Formulas inside workbooks: a graph of cells, evaluated on demand.

A cell is computed once, after the cells that it reads, from a stack of our own: chains of any length are evaluated.
Cached values win over evaluation, but an empty one is evaluated when another formula reads it.

Cycles: cells are taken in order of sheet and place.  While a cell that another one reads is being computed, it reads as
blank; the cell taken first is not marked so itself, and its last value counts.  So ``A1=A2+1`` with ``A2=A1+1`` gives 3 and 2.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address, scalars
from ..functions.coerce import to_number
from ..functions.library import Unsupported
from .lexer import FormulaError
from .parser import Array, Binary, Call, Cell, ErrorValue, Literal, Name, Postfix, Range, Structured, Unary, parse


def scalar(text: str | None):
    """A cell's text as a value: blank, truth value, number or trimmed text."""
    t = (text or "").strip()
    if t in ("TRUE", "FALSE"):
        return t == "TRUE"
    n = to_number(t) if t else None
    return t if n is None else n


def serialized(value) -> str | None:
    """A value as a cell's text; arrays and missing values are none."""
    if value is None or isinstance(value, list):
        return None
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return scalars.words(value)


def key(name: str) -> str:
    return unicodedata.normalize("NFKC", name).strip().upper()


@dataclass
class ListObject:
    sheet: str
    start: str
    end: str
    columns: list[str]
    header_rows: int = 1
    totals_rows: int = 0


@dataclass
class Book:
    """What formulas see of a workbook: values and formulas by (sheet, row, column), names and list objects."""

    values: dict[tuple[str, int, int], str] = field(default_factory=dict)
    formulas: dict[tuple[str, int, int], str] = field(default_factory=dict)
    sheets: set[str] = field(default_factory=set)
    names: dict[tuple[str, str], str] = field(default_factory=dict)  # (sheet or "", key)
    tables: dict[str, ListObject] = field(default_factory=dict)
    today: dt.date | None = None


Place = tuple[str, int, int]
_tree = lru_cache(maxsize=10_000)(parse)


class _Unread(Exception):
    """Cells that have to be computed first."""

    def __init__(self, cells: list[Place]):
        super().__init__()
        self.cells = cells


class Evaluator:
    def __init__(self, book: Book):
        self.book, self.done, self.running = book, {}, set()

    def value(self, sheet: str, row: int, col: int) -> str:
        """A cell's text; formulas that fail read as blank."""
        self.settle((sheet, row, col))
        return self.read(sheet, row, col)

    def read(self, sheet: str, row: int, col: int) -> str:
        """The text of a cell that is known, or being computed."""
        if sheet not in self.book.sheets:
            return "#REF!"
        at = (sheet, row, col)
        if at not in self.book.formulas:
            return self.book.values.get(at, "")
        if at in self.done:
            return self.done[at] or ""
        if at in self.running:
            return ""
        raise _Unread([at])

    def settle(self, first: Place, marked: bool = True) -> None:
        """Computes a cell and all that it reads.  marked: whether it reads as blank where a cycle comes back to it."""
        if first not in self.book.formulas or first in self.done:
            return
        self.running = {first} if marked else set()
        stack: list[tuple[Place, list[Place]]] = [(first, [])]
        while stack:
            at, before = stack[-1]
            if before:
                nearest = before.pop()
                if nearest not in self.done and nearest not in self.running:
                    self.running.add(nearest)
                    stack.append((nearest, []))
                continue
            try:
                self.done[at] = self.attempt(at[0], self.book.formulas[at], *at[1:])
            except _Unread as u:
                before += reversed(u.cells)
                continue
            stack.pop()
            self.running.discard(at)

    def formula(self, sheet: str, text: str, row: int = 0, col: int = 0) -> str | None:
        """A formula's result as text, None where it cannot be evaluated."""
        while True:
            try:
                return self.attempt(sheet, text, row, col)
            except _Unread as u:
                for at in u.cells:
                    self.settle(at)

    def attempt(self, sheet: str, text: str, row: int, col: int) -> str | None:
        """:meth:`formula`, or :class:`_Unread` if it reads a cell that is not known yet."""
        try:
            return serialized(_Scope(self, sheet, row, col).run(_tree(text)))
        except (FormulaError, Unsupported, TypeError, ValueError, IndexError, OverflowError, ZeroDivisionError):
            return None

    def matrix(self, sheet: str, area: tuple[int, int, int, int]) -> list[list]:
        r1, c1, r2, c2 = area
        places = [[(sheet, r, c) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]
        formulas, done, running = self.book.formulas, self.done, self.running
        unread = [p for line in places for p in line if p in formulas and p not in done and p not in running]
        if unread:
            raise _Unread(unread)
        return [[scalar(self.read(*p)) for p in line] for line in places]

    def name(self, sheet: str, name: str):
        """A defined name's value; the sheet's own before the workbook's."""
        text = self.book.names.get((sheet, key(name))) or self.book.names.get(("", key(name)))
        if not text:
            return None
        return _Scope(self, sheet, 0, 0).run(_tree(text))


class _Scope:
    def __init__(self, owner: Evaluator, sheet: str, row: int, col: int):
        self.owner, self.sheet, self.row, self.col = owner, sheet, row, col

    def run(self, node):
        match node:
            case Literal(value=v):
                return v
            case ErrorValue(code=c):
                return c
            case Array(rows=rows):
                return [[self.run(x) for x in r] for r in rows]
            case Cell(ref=ref, sheet=s):
                return scalar(self.owner.read(s or self.sheet, *address.cell(ref)))
            case Name(name=n, sheet=s):
                return self.owner.name(s or self.sheet, n)
            case Range():
                sheet, area = self.area(node)
                return self.owner.matrix(sheet, area) if area else [self.run(node.start), self.run(node.end)]
            case Structured(table=t, column=c, qualifier=q):
                return self.structured(t, c) if q is None else None
            case Unary(op=op, operand=x):
                return -scalars.number(self.run(x)) if op == "-" else scalars.number(self.run(x))
            case Postfix(op="#"):
                return []
            case Postfix(operand=x):
                return scalars.number(self.run(x)) / 100
            case Binary(op=" ", left=a, right=b):
                return self.intersection(a, b)
            case Binary():
                rest = []  # long sums lean to the left: no recursion along them
                while isinstance(node, Binary) and node.op != " ":
                    rest.append((node.op, node.right))
                    node = node.left
                out = self.run(node)
                for op, right in reversed(rest):
                    out = self.binary(op, out, self.run(right))
                return out
            case Call(name=name, args=args):
                return self.call(name, args)
        raise FormulaError(f"cannot be evaluated: {node}")

    def area(self, node) -> tuple[str | None, tuple | None]:
        """(sheet, rectangle) of a cell, a range, or a range whose end INDEX computes."""
        match node:
            case Cell(ref=ref, sheet=s):
                return s or self.sheet, address.rectangle(ref)
            case Range(start=Cell(ref=a, sheet=s), end=Cell(ref=b)):
                return s or self.sheet, address.rectangle(f"{a}:{b}")
            case Range(start=Cell(ref=a, sheet=s), end=Call(name="INDEX", args=args)):
                sheet, box = self.area(args[0])
                r = int(scalars.number(self.run(args[1]))) if len(args) > 1 else 1
                c = int(scalars.number(self.run(args[2]))) if len(args) > 2 else 1
                if box and r > 0 and c > 0 and box[0] + r - 1 <= box[2] and box[1] + c - 1 <= box[3]:
                    return s or self.sheet, address.rectangle(f"{a}:{address.name(box[0] + r - 1, box[1] + c - 1)}")
        return None, None

    def intersection(self, a, b):
        (s, x), (t, y) = self.area(a), self.area(b)
        if not x or not y:
            raise FormulaError("only cells and ranges intersect")
        box = max(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), min(x[3], y[3])
        if s != t or box[0] > box[2] or box[1] > box[3]:
            return "#NULL!"
        return self.owner.matrix(s, box)

    def structured(self, table: str, column: str):
        t = self.owner.book.tables.get(key(table))
        if t is None or column[:1] in ("#", "@"):
            return None
        at = [key(c) for c in t.columns].index(key(column)) if key(column) in map(key, t.columns) else -1
        box = address.rectangle(f"{t.start}:{t.end}")
        if at < 0 or not box:
            return None
        first, last, col = box[0] + max(0, t.header_rows), box[2] - max(0, t.totals_rows), box[1] + at
        return self.owner.matrix(t.sheet, (first, col, last, col)) if first <= last else None

    @staticmethod
    def binary(op: str, a, b):
        if op == "&":
            return scalars.words(a) + scalars.words(b)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return scalars.compared(a, op, b)
        x, y = scalars.number(a), scalars.number(b)
        if op == "/":
            return x / y if y else float("nan") if x == 0 or x != x else float("inf") if x > 0 else float("-inf")
        return {"+": x + y, "-": x - y, "*": x * y}[op]

    def call(self, name: str, args):
        lazy: Callable | None = getattr(self, f"do_{name.lower()}", None)
        if lazy is not None:
            return lazy(args)
        if name not in scalars.FUNCTIONS:
            raise Unsupported(name)
        return scalars.FUNCTIONS[name](*[self.run(a) for a in args])

    def do_if(self, args):
        if scalars.truth(self.run(args[0])):
            return self.run(args[1]) if len(args) > 1 else True
        return self.run(args[2]) if len(args) > 2 else False

    def do_iferror(self, args):
        v = self.run(args[0])
        return (self.run(args[1]) if len(args) > 1 else "") if scalars.is_error(v) else v

    def do_and(self, args):
        return all(scalars.truth(self.run(a)) for a in args)

    def do_or(self, args):
        return any(scalars.truth(self.run(a)) for a in args)

    def do_choose(self, args):
        i = int(scalars.number(self.run(args[0])))
        return self.run(args[i]) if 1 <= i < len(args) else None

    def do_today(self, args):
        return float(((self.owner.book.today or dt.datetime.now(dt.UTC).date()) - dt.date(1899, 12, 30)).days)

    def place(self, args, which: int) -> float:
        if not args:
            here = (self.row, self.col)[which]
            if not here:
                raise Unsupported("no current cell")
            return float(here)
        node = args[0].start if isinstance(args[0], Range) else args[0]
        text = node.ref if isinstance(node, Cell) else scalars.words(self.run(node))
        m = re.search(r"\$?[A-Za-z]{1,3}\$?\d+", text)
        if not m:
            raise Unsupported("no reference")
        return float(address.cell(m[0])[which])

    def do_row(self, args):
        return self.place(args, 0)

    def do_column(self, args):
        return self.place(args, 1)


RESULT = "workbook string, sheet_index int, row int, col int, resolved string"
NAME = ("sheet", "name", "formula")
TABLE = ("sheet", "name", "start", "end", "columns", "header_rows", "totals_rows")


def resolve(cells: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    """(workbook, sheet_index, row, col, resolved) of the formulas without a cached value, and of those with an empty one that
    another formula reads.

    cells(workbook, sheet_index, sheet_name, ord, row, col, formula, pending, empty, value), names(workbook, sheet, name,
    formula), tables(workbook, sheet, name, start, end, columns, header_rows, totals_rows).  pending: to be evaluated;
    empty: to be evaluated if it is read.  Only workbooks with a pending formula are gathered; the rows of each stream into
    one task in order, since a workbook is the unit that a formula can reach.  Empty tables give an empty table.

    They are dealt by a hash of the workbook: Spark leaves out a repartition by the workbook itself where the parts of the union
    have that partitioning, and may then coalesce those parts apart or join them by broadcast.
    """
    busy = cells.where("pending").select("workbook").distinct()
    rows = cells.select("workbook", F.lit(2).alias("kind"), "sheet_index", "sheet_name", F.col("ord").cast("long").alias("ord"), "row", "col", "formula", "pending", "empty", "value")
    rows = rows.unionByName(names.select("workbook", F.lit(0).alias("kind"), *NAME), allowMissingColumns=True)
    rows = rows.unionByName(tables.select("workbook", F.lit(1).alias("kind"), *TABLE), allowMissingColumns=True)
    rows = rows.join(busy, "workbook", "left_semi").repartition(F.xxhash64("workbook")).sortWithinPartitions("workbook", "kind", "sheet_index", "ord", "row", "col")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book: _Reading | None = None
        for f in frames:
            for r in f.itertuples(index=False):
                if book is None or book.name != r.workbook:
                    if book is not None:
                        yield book.frame()
                    book = _Reading(r.workbook)
                book.add(r)
        if book is not None:
            yield book.frame()

    return rows.mapInPandas(run, RESULT)


class _Reading:
    """A workbook as its rows come in."""

    def __init__(self, name: str):
        self.name, self.book, self.pending, self.index = name, Book(), [], {}

    def add(self, r) -> None:
        if r.kind == 0:
            self.book.names[r.sheet or "", key(r.name)] = r.formula
        elif r.kind == 1:
            self.book.tables[key(r.name)] = ListObject(r.sheet, r.start, r.end, list(r.columns), int(r.header_rows), int(r.totals_rows))
        else:
            at = (r.sheet_name, int(r.row), int(r.col))
            self.book.sheets.add(r.sheet_name)
            self.index[r.sheet_name] = int(r.sheet_index)
            if r.pending or r.empty:
                self.book.formulas[at] = r.formula
            else:
                self.book.values[at] = r.value or ""
            if r.pending:
                self.pending.append(at)

    def frame(self) -> pd.DataFrame:
        found = [(self.name, self.index[at[0]], at[1], at[2], text) for at, text in solved(self.book, self.pending).items()]
        return pd.DataFrame(found, columns=["workbook", "sheet_index", "row", "col", "resolved"])


def solved(book: Book, pending: Iterable[Place]) -> dict[Place, str | None]:
    """The results of the pending formulas in their order, and of all that they read."""
    run = Evaluator(book)
    for at in pending:
        run.settle(at, marked=False)
    return run.done

"""The spreadsheet functions as builders of Spark columns.

``SCALARS``: name -> builder(args) for one row.  ``AGGREGATES``: name -> builder(args) over the rows of a group; their
range arguments are columns.  A builder takes and gives :class:`coerce.Val`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .coerce import BLANKS, Val, boolean, compare, criteria, date_of, date_serial, date_text_serial, equal, is_bool, is_error, is_num, is_number_text, lit, make_serial, num, num_to_text, serial_of, text, text_to_num

SCALARS: dict[str, Callable] = {}
AGGREGATES: dict[str, Callable] = {}


class Unsupported(ValueError):
    """The function does not take these arguments."""


def _scalar(name: str):
    return lambda f: SCALARS.setdefault(name, f)


def _aggregate(name: str):
    return lambda f: AGGREGATES.setdefault(name, f)


def same_kind(options: Sequence[Val]) -> tuple[list[Column], str]:
    """Columns of one type for the branches of a choice: their own if all agree, else cell texts."""
    kinds = {o.kind for o in options}
    if len(kinds) == 1:
        return [o.col for o in options], kinds.pop()
    return [F.when(o.col, "TRUE").otherwise("FALSE") if o.kind == "bool" else text(o) if o.kind == "num" else o.col for o in options], "cell"


def whole(v: Val) -> Column:
    return F.floor(num(v)).cast("int")


def trunc(v: Val) -> Column:
    n = num(v)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("int")


# ---------------------------------------------------------------- logic


@_scalar("IF")
def _if(args):
    then = args[1] if len(args) > 1 else lit(True)
    other = args[2] if len(args) > 2 else lit(False)
    (a, b), kind = same_kind([then, other])
    return Val(F.when(boolean(args[0]), a).otherwise(b), kind)


@_scalar("IFERROR")
def _iferror(args):
    (a, b), kind = same_kind([args[0], args[1] if len(args) > 1 else lit("")])
    return Val(F.when(is_error(args[0]), b).otherwise(a), kind)


@_scalar("AND")
def _and(args):
    return Val(reduce(lambda a, b: a & b, map(boolean, args), F.lit(True)), "bool")


@_scalar("OR")
def _or(args):
    return Val(reduce(lambda a, b: a | b, map(boolean, args), F.lit(False)), "bool")


@_scalar("NOT")
def _not(args):
    return Val(~boolean(args[0]), "bool")


@_scalar("CHOOSE")
def _choose(args):
    cols, kind = same_kind(args[1:])
    i, out = trunc(args[0]), F.lit(None)
    for k, c in reversed(list(enumerate(cols, 1))):
        out = F.when(i == k, c).otherwise(out)
    return Val(out, kind)


@_scalar("ISBLANK")
def _isblank(args):
    v = args[0]
    return Val(F.lit(False) if v.kind in ("num", "bool") else v.col.isNull() | (v.col == ""), "bool")


@_scalar("ISNUMBER")
def _isnumber(args):
    v = args[0]
    if v.kind == "text":
        return Val(is_number_text(F.coalesce(v.col, F.lit(""))), "bool")
    return Val(is_num(v) if v.kind == "cell" else F.lit(v.kind == "num"), "bool")


@_scalar("ISTEXT")
def _istext(args):
    v = args[0]
    return Val(~(is_num(v) | is_bool(v)) if v.kind == "cell" else F.lit(v.kind == "text"), "bool")


@_scalar("ISERROR")
def _iserror(args):
    return Val(is_error(args[0]), "bool")


@_scalar("ISNA")
def _isna(args):
    return Val(F.lit(False) if args[0].kind in ("num", "bool") else F.coalesce(args[0].col == "#N/A", F.lit(False)), "bool")


@_scalar("NA")
def _na(args):
    return lit("#N/A")


# ---------------------------------------------------------------- numbers


def factor(v: Val | None) -> Column:
    if v is None:
        return F.lit(1.0)
    if v.literal is not None and isinstance(v.literal, float):
        return F.lit(math.pow(10, math.trunc(v.literal)))
    return F.pow(F.lit(10.0), trunc(v))


def _rounded(mode: Callable[[Column], Column]):
    def build(args):
        f = factor(args[1] if len(args) > 1 else None)
        return Val(mode(num(args[0]) * f).cast("double") / f, "num")

    return build


#: Halves go up, also below zero.
SCALARS["ROUND"] = _rounded(lambda x: F.floor(x + 0.5))
SCALARS["ROUNDUP"] = _rounded(lambda x: F.when(x >= 0, F.ceil(x)).otherwise(F.floor(x)))
SCALARS["ROUNDDOWN"] = _rounded(lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))


@_scalar("INT")
def _int(args):
    return Val(F.floor(num(args[0])).cast("double"), "num")


@_scalar("ABS")
def _abs(args):
    return Val(F.abs(num(args[0])), "num")


@_scalar("VALUE")
def _value(args):
    v = args[0]
    if v.kind == "num":
        return v
    t = text(v)
    t = F.regexp_replace(t, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return Val(F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(date_text_serial(t), F.when(is_number_text(t), text_to_num(t)))), "num")


# ---------------------------------------------------------------- text


def _text_builder(name: str, build: Callable):
    SCALARS[name] = lambda args: Val(build(*args), "text")


_text_builder("LOWER", lambda t: F.lower(text(t)))
_text_builder("UPPER", lambda t: F.upper(text(t)))
_text_builder("TRIM", lambda t: F.regexp_replace(F.regexp_replace(text(t), f"[{BLANKS}]+", " "), "^ | $", ""))
_text_builder("CONCATENATE", lambda *ts: F.concat(*map(text, ts)) if ts else F.lit(""))
_text_builder("LEFT", lambda t, n=None: F.left(text(t), F.greatest(whole(n), F.lit(0)) if n else F.lit(1)))
_text_builder("RIGHT", lambda t, n=None: F.right(text(t), F.greatest(whole(n), F.lit(0)) if n else F.lit(1)))
_text_builder("MID", lambda t, s, n: F.substring(text(t), F.greatest(whole(s), F.lit(1)), F.greatest(whole(n), F.lit(0))))
_text_builder("REPT", lambda t, n: F.repeat(text(t), F.greatest(whole(n), F.lit(0))))


@_scalar("LEN")
def _len(args):
    """UTF-16 code units: a character beyond the basic plane counts twice."""
    t = text(args[0])
    return Val((F.length(F.encode(t, "UTF-16BE")) / 2).cast("double"), "num")


def _find(lower: bool):
    def build(args):
        find, within = text(args[0]), text(args[1])
        if lower:
            find, within = F.lower(find), F.lower(within)
        start = F.greatest(whole(args[2]), F.lit(1)) if len(args) > 2 else F.lit(1)
        at = F.when(find == "", F.least(start, F.char_length(within) + 1)).otherwise(F.call_function("locate", find, within, start))
        return Val(F.when(at == 0, F.lit("#VALUE!")).otherwise(at.cast("string")), "cell")

    return build


SCALARS["FIND"], SCALARS["SEARCH"] = _find(False), _find(True)


@_scalar("SUBSTITUTE")
def _substitute(args):
    t, old, new = (text(a) for a in args[:3])
    every = F.when(old == "", t).otherwise(F.replace(t, old, new))
    if len(args) < 4:
        return Val(every, "text")
    n = whole(args[3])
    parts = F.split(t, F.concat(F.lit("\\Q"), F.replace(old, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    nth = F.concat(F.call_function("array_join", F.slice(parts, F.lit(1), n), old), new, F.call_function("array_join", F.slice(parts, n + 1, F.size(parts)), old))
    return Val(F.when(old == "", t).when(n < 1, every).when(F.size(parts) <= n, t).otherwise(nth), "text")


@_scalar("REPLACE")
def _replace(args):
    t, start, n, new = text(args[0]), F.greatest(whole(args[1]), F.lit(1)), F.greatest(whole(args[2]), F.lit(0)), text(args[3])
    return Val(F.concat(F.left(t, start - 1), new, F.substring(t, start + n, F.char_length(t))), "text")


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def grouped(x: Column, digits: int) -> Column:
    """Thousands separated; halves away from zero."""
    return F.format_number(F.round(x, digits), digits)


@_scalar("TEXT")
def _text(args):
    """Formats 0000, 0, 0.0, 0.00, #,##0, #,##0.00, dates with / (no zeros in front) or - (two digits), hh:mm:ss; other
    formats leave the value."""
    v, f = args[0], args[1].literal
    if not isinstance(f, str):
        raise Unsupported("TEXT takes a constant format")
    f, x = f.lower(), num(v)
    if f == "0000":
        n = F.floor(F.abs(x)).cast("string")
        return Val(F.concat(F.when(x < 0, "-").otherwise(""), F.lpad(n, F.greatest(F.char_length(n), F.lit(4)), "0")), "text")
    if f in ("0", "0.0", "0.00"):
        return Val(fixed(x, len(f.partition(".")[2])), "text")
    if f in ("#,##0", "#,##0.00"):
        return Val(grouped(x, len(f.partition(".")[2])), "text")
    d = date_of(x)
    if f == "yyyy/mm/dd":
        return Val(F.concat_ws("/", F.year(d), F.month(d), F.day(d)), "text")
    if f == "yyyy-mm-dd":
        return Val(F.date_format(d, "yyyy-MM-dd"), "text")
    if f == "hh:mm:ss":
        s = F.floor(F.pmod(x, F.lit(1.0)) * 86400 + 0.5).cast("int") % 86400
        return Val(F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60), "text")
    return Val(text(v), "text")


# ---------------------------------------------------------------- dates


@_scalar("DATE")
def _date(args):
    return Val(make_serial(*(num(a) for a in args[:3])), "num")


@_scalar("DATEVALUE")
def _datevalue(args):
    return Val(date_text_serial(text(args[0])), "num")


@_scalar("TODAY")
def _today(args):
    return Val(serial_of(F.current_date()), "num")


def _part(get: Callable[[Column], Column]):
    return lambda args: Val(get(date_of(date_serial(args[0]))).cast("double"), "num")


SCALARS["DAY"], SCALARS["MONTH"], SCALARS["YEAR"] = _part(F.day), _part(F.month), _part(F.year)


@_scalar("WEEKDAY")
def _weekday(args):
    d = date_of(num(args[0]))
    sunday, monday = F.dayofweek(d).cast("double"), F.weekday(d).cast("double")
    kind = whole(args[1]) if len(args) > 1 else F.lit(1)
    return Val(F.when(kind == 2, monday + 1).when(kind == 3, monday).otherwise(sunday), "num")


@_scalar("EDATE")
def _edate(args):
    """Days past the month's end run on into the next."""
    d = date_of(date_serial(args[0]))
    return Val(serial_of(F.date_add(F.add_months(F.trunc(d, "MM"), trunc(args[1])), F.day(d) - 1)), "num")


@_scalar("EOMONTH")
def _eomonth(args):
    d = date_of(date_serial(args[0]))
    return Val(serial_of(F.last_day(F.add_months(F.trunc(d, "MM"), trunc(args[1])))), "num")


# ---------------------------------------------------------------- aggregates


def _each(args) -> list[Column]:
    return [num(a) for a in args]


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def countable(v: Val) -> Column:
    """Numbers and texts that look like one; truth values do not count."""
    if v.kind in ("num", "bool"):
        return v.col.isNotNull() & F.lit(v.kind == "num")
    return F.coalesce(is_number_text(v.col), F.lit(False))


def present(v: Val) -> Column:
    return v.col.isNotNull() & (F.lit(True) if v.kind in ("num", "bool") else v.col != "")


@_aggregate("SUM")
def _sum(args):
    return Val(F.coalesce(F.sum(_total(_each(args))), F.lit(0.0)), "num")


@_aggregate("SUMPRODUCT")
def _sumproduct(args):
    return Val(F.coalesce(F.sum(reduce(lambda a, b: a * b, _each(args))), F.lit(0.0)), "num")


@_aggregate("AVERAGE")
def _average(args):
    """Blanks and texts count as 0, above and below; an empty group gives #DIV/0!."""
    return Val(F.coalesce(num_to_text(F.avg(_total(_each(args)) / len(args))), F.lit("#DIV/0!")), "cell")


@_aggregate("MIN")
def _min(args):
    return Val(F.coalesce(F.min(F.least(*_each(args)) if len(args) > 1 else num(args[0])), F.lit(0.0)), "num")


@_aggregate("MAX")
def _max(args):
    return Val(F.coalesce(F.max(F.greatest(*_each(args)) if len(args) > 1 else num(args[0])), F.lit(0.0)), "num")


@_aggregate("COUNT")
def _count(args):
    return Val(_total([F.count_if(countable(a)) for a in args]).cast("double"), "num")


@_aggregate("COUNTA")
def _counta(args):
    return Val(_total([F.count_if(present(a)) for a in args]).cast("double"), "num")


def _pairs(args) -> Column:
    """All (range, criterion) pairs of the arguments at once."""
    tests = []
    for v, c in zip(args[::2], args[1::2], strict=True):
        if c.literal is None:
            raise Unsupported("a criterion must be a constant")
        tests.append(criteria(v, c.literal))
    return reduce(lambda a, b: a & b, tests)


def _sum_where(test: Column, v: Val) -> Val:
    return Val(F.coalesce(F.sum(F.when(test, num(v))), F.lit(0.0)), "num")


def _average_where(test: Column, v: Val) -> Val:
    return Val(F.coalesce(num_to_text(F.avg(F.when(test, num(v)))), F.lit("#DIV/0!")), "cell")


AGGREGATES["COUNTIF"] = AGGREGATES["COUNTIFS"] = lambda args: Val(F.count_if(_pairs(args)).cast("double"), "num")
AGGREGATES["SUMIF"] = lambda args: _sum_where(_pairs(args[:2]), args[2] if len(args) > 2 else args[0])
AGGREGATES["AVERAGEIF"] = lambda args: _average_where(_pairs(args[:2]), args[2] if len(args) > 2 else args[0])
AGGREGATES["SUMIFS"] = lambda args: _sum_where(_pairs(args[1:]), args[0])
AGGREGATES["AVERAGEIFS"] = lambda args: _average_where(_pairs(args[1:]), args[0])


@_aggregate("SUBTOTAL")
def _subtotal(args):
    """Codes 1, 4, 5, 9 and their hundreds; hidden rows count.  The maximum of nothing is -Infinity."""
    code = args[0].literal
    values = _total(_each(args[1:])) if len(args) == 2 else None
    match int(code) % 100 if code is not None and int(code) in (1, 4, 5, 9, 101, 104, 105, 109) else None:
        case 1:
            return _average(args[1:])
        case 4:
            return Val(F.coalesce(F.max(values if values is not None else F.greatest(*_each(args[1:]))), F.lit(float("-inf"))), "num")
        case 5:
            return Val(F.coalesce(F.min(values if values is not None else F.least(*_each(args[1:]))), F.lit(float("inf"))), "num")
        case 9:
            return _sum(args[1:])
    raise Unsupported(f"SUBTOTAL does not know code {code}")


#: Scalar functions for SQL text: bodies that the optimizer inlines.
SQL_FUNCTIONS = {
    "xl_round": ("x DOUBLE, n INT", "DOUBLE", "floor(x * power(10, n) + 0.5) / power(10, n)"),
    "xl_roundup": ("x DOUBLE, n INT", "DOUBLE", "CASE WHEN x >= 0 THEN ceil(x * power(10, n)) ELSE floor(x * power(10, n)) END / power(10, n)"),
    "xl_rounddown": ("x DOUBLE, n INT", "DOUBLE", "CASE WHEN x >= 0 THEN floor(x * power(10, n)) ELSE ceil(x * power(10, n)) END / power(10, n)"),
    "xl_int": ("x DOUBLE", "DOUBLE", "CAST(floor(x) AS DOUBLE)"),
    "xl_serial": ("d DATE", "DOUBLE", "CAST(datediff(d, DATE'1899-12-30') AS DOUBLE)"),
    "xl_date": ("s DOUBLE", "DATE", "date_add(DATE'1899-12-30', CAST(floor(s) AS INT))"),
    "xl_edate": ("s DOUBLE, m INT", "DOUBLE", "CAST(datediff(date_add(add_months(trunc(date_add(DATE'1899-12-30', CAST(floor(s) AS INT)), 'MM'), m), day(date_add(DATE'1899-12-30', CAST(floor(s) AS INT))) - 1), DATE'1899-12-30') AS DOUBLE)"),
    "xl_is_error": ("v STRING", "BOOLEAN", r"coalesce(v RLIKE r'^#(N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!|NULL!)', false)"),
    "xl_left": ("t STRING, n INT", "STRING", "left(t, greatest(n, 0))"),
}


def register_sql(spark: SparkSession) -> None:
    """Registers ``xl_*`` as temporary SQL functions of the session."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")


__all__ = ["AGGREGATES", "SCALARS", "SQL_FUNCTIONS", "Unsupported", "compare", "equal", "lit", "register_sql", "same_kind"]

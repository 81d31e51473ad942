"""Number formats: what a cell shows for its raw value.

A format code is read once, in plain Python, into a :class:`Shown`: which of a dozen ways of showing a number it asks for,
and with how many digits.  For a literal code only that way becomes an expression; a column of codes is read by distinct
value (:func:`shown_of`), so a row costs a comparison of the way's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import DECIMAL, EPOCH, let, strip

#: Built-in number formats by id.  Fixed values.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
    13: "# ??/??", 14: "yyyy/m/d", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@", 56: "m月d日",
}
#: First year of an era and its name, newest first.  Fixed values.
ERAS = ((2019, "令和"), (1989, "平成"))
#: Date codes with a way of their own; other date codes show date, time or both.  Fixed values.
DATES = {"yyyy/m/d": "slashes", "yyyy/mm/dd": "slashes", "m月d日": "month_day", "yyyy-mm-dd": "date", "hh:mm:ss": "time"}
ERA_CODE = "ggge年m月d日"
#: Format ids with a way of their own: digits apart, and yen without a sign.  Fixed values.
DIGITS_APART, PLAIN_YEN = 186, 42
#: Currency signs in a zero section and what zero shows with them.  Fixed values.
ZERO_SIGNS = {"¥": "¥ -", "$": "$ -"}
DAY_MS = 86_400_000


# ---------------------------------------------------------------- reading a code


@dataclass(frozen=True)
class Shown:
    """How a format shows numbers.  way: its name (None: as they are); digits after the point; power: digits of an
    exponent; commas between thousands; yen: a sign in front; zero: what 0 shows instead."""

    way: str | None = None
    digits: int = 0
    power: int = 0
    commas: bool = False
    yen: bool = False
    zero: str | None = None


SHOWN = "struct<way:string,digits:int,power:int,commas:boolean,yen:boolean,zero:string>"


def letters_of_code(code: str) -> Iterator[str]:
    """The characters of a code that stand for themselves or for digits: those of quotes and escapes too, but not tags in
    brackets, the padding ``_x`` and the fill mark ``*``."""
    code, at = code.strip(), 0
    while at < len(code):
        c, at = code[at], at + 1
        close = code.find({"[": "]", '"': '"'}.get(c, "\0"), at)
        if c == "[" and close >= 0:
            at = close + 1
        elif c == '"' and close >= 0:
            yield from code[at:close]
            at = close + 1
        elif c == "\\" and at < len(code):
            yield code[at]
            at += 1
        elif c == "_":
            at += 1
        elif c != "*":
            yield c


def _words(text: str) -> list[str]:
    """Runs of letters a to z, and each other character."""
    out: list[str] = []
    for c in text:
        if "a" <= c <= "z" and out and "a" <= out[-1][0] <= "z":
            out[-1] += c
        else:
            out.append(c)
    return out


def _date(low: str) -> str:
    if low in DATES:
        return DATES[low]
    if ERA_CODE in low:
        return "era"
    words = ["", *_words(low), ""]
    month = any(w == "m" and ({words[i - 1], words[i + 1]} & {"/", "-"}) for i, w in enumerate(words) if w)
    day = "y" in low or "d" in low or month
    clock = any(c in low for c in "hs:") or "am/pm" in low
    return "date_time" if day and clock else "time" if clock else "date"


def _places(section: str) -> int:
    """Digits between a section's first point and its second."""
    points = section.split(".")
    return sum(c in "0#" for c in points[1]) if len(points) > 1 else 0


def _exponent(section: str) -> tuple[int, int] | None:
    """(digits after the point, digits of the exponent) of a section with an exponent behind a digit."""
    head, mark, tail = section.partition("e+")
    if not mark or not tail.startswith("0") or not set(head) & set("0#"):
        return None
    fraction = head.rpartition(".")
    digits = len(fraction[2]) if fraction[1] and fraction[2] and set(fraction[2]) <= set("0#") else 0
    return digits, len(tail) - len(tail.lstrip("0#"))


def _zero(section: str) -> str | None:
    """What a section shows for 0 if it is a dash, alone or with a currency sign."""
    around = f" {section.replace('?', '')} "
    plain = lambda c: c.isascii() and c.isalnum()
    if not any(c == "-" and not plain(around[i - 1]) and not plain(around[i + 1]) for i, c in enumerate(around)):
        return None
    return next((out for sign, out in ZERO_SIGNS.items() if sign in section), "-")


def shown(code: str | None, format_id: int | None = 0) -> Shown:
    """What a format code and its id ask for."""
    low = "".join(letters_of_code(code or "")).lower()
    if set(low) & set("ymdhs") and "general" not in low:
        return Shown(_date(low))
    sections = low.split(";")
    first, zero = sections[0].strip(), _zero(sections[2]) if len(sections) > 2 else None
    if "%" in low:
        return Shown("percent", _places(sections[0]), zero=zero)
    if format_id == DIGITS_APART or "dbnum3" in low:
        return Shown("apart", zero=zero)
    if format_id == PLAIN_YEN:
        return Shown("plain_yen", commas=True, zero=zero)
    if any(_exponent(s) for s in sections):
        digits, power = _exponent(sections[0]) or (0, 0)
        return Shown("scientific", digits, power, zero=zero)
    if "?/?" in low:
        return Shown("fraction", zero=zero)
    if set(first) & set("#0,"):
        return Shown("number", _places(first), commas="," in first, yen="¥" in first, zero=zero)
    return Shown(zero=zero)


def shown_of(code: Column, format_id: Column) -> Column:
    """:func:`shown` of columns, as a struct; each distinct pair of a batch is read once."""

    @F.pandas_udf(SHOWN)
    def read(c: pd.Series, i: pd.Series) -> pd.DataFrame:
        known: dict[tuple, dict] = {}
        pairs = list(zip(c.fillna(""), i.fillna(0).astype(int), strict=True))
        return pd.DataFrame([known.get(p) or known.setdefault(p, asdict(shown(*p))) for p in pairs], columns=list(Shown.__dataclass_fields__))

    return read(code, format_id)


# ---------------------------------------------------------------- dates


def date_text(serial: Column, way: str) -> Column:
    """A serial, to the nearest millisecond, in one of the ways of date codes."""
    whole = F.floor(serial)
    ms = whole * DAY_MS + F.floor((serial - whole) * DAY_MS + 0.5)
    return let(ms, lambda ms: let(F.floor(ms / DAY_MS), lambda n: _date_in_way(F.date_add(F.lit(EPOCH).cast("date"), n.cast("int")), F.floor((ms - n * DAY_MS) / 1000).cast("int"), way)))


def _date_in_way(day: Column, second: Column, way: str) -> Column:
    y, m, d = F.year(day), F.month(day), F.day(day)
    if way == "slashes":
        return F.concat_ws("/", y, m, d)
    if way in ("month_day", "era"):
        short = F.concat(m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))
        if way == "month_day":
            return short
        year = y.cast("string")
        for first, name in reversed(ERAS):
            year = F.when(y >= first, F.concat(F.lit(name), (y - first + 1).cast("string"))).otherwise(year)
        return F.concat(year, F.lit("年"), short)
    iso = F.date_format(day, "yyyy-MM-dd")
    if way == "date":
        return iso
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), F.floor(second / 60).cast("int") % 60, second % 60)
    return clock if way == "time" else F.concat(iso, F.lit(" "), clock)


# ---------------------------------------------------------------- numbers


def half_away(x: Column, digits: int | Column) -> Column:
    """The shortest decimal rounded, halves away from zero; digits from a column beyond 6 round the double itself.  A number
    below zero that rounds to it keeps its sign, and so does -0.0 (``round`` has none)."""
    size = F.abs(x)
    if isinstance(digits, int):
        out = F.round(size, digits)
    else:
        f = F.pow(F.lit(10.0), digits)
        out = F.floor(size * f + 0.5) / f
        for n in range(6, -1, -1):
            out = F.when(digits == n, F.round(size, n)).otherwise(out)
    return F.when(x == 0, x).when(x < 0, -1.0 * out).otherwise(out)


def fixed(x: Column, digits: int | Column, commas: bool | Column) -> Column:
    """Fixed decimals, with or without commas between thousands."""
    out = F.call_function("format_number", half_away(x, digits), F.lit(digits) if isinstance(digits, int) else digits)
    bare = lambda t: F.replace(t, F.lit(","), F.lit(""))
    if isinstance(commas, bool):
        return out if commas else bare(out)
    return let(out, lambda t: F.when(commas, t).otherwise(bare(t)))


def _printed(x: Column, digits: int | Column, letter: str) -> Column:
    if isinstance(digits, int):
        return F.format_string(f"%.{digits}{letter}", x)
    return F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit(letter)), x)


def scientific(x: Column, digits: int | Column, power: int | Column) -> Column:
    out = F.split(_printed(x, digits, "E"), "E")
    e = out[1].try_cast("int")
    size = F.abs(e).cast("string")
    wide = F.greatest(F.lit(power) if isinstance(power, int) else power, F.length(size))
    return F.concat(out[0], F.when(e >= 0, "E+").otherwise("E-"), F.lpad(size, wide, "0"))


def fraction(x: Column) -> Column:
    """The smallest denominator up to 100 that is exact to 1e-9, else null."""
    top = lambda d: F.floor(x * d + 0.5)
    fits = F.filter(F.sequence(F.lit(1), F.lit(100)), lambda d: F.abs(x - top(d) / d) < 1e-9)
    d = F.try_element_at(fits, F.lit(1))
    return F.concat(top(d).cast("string"), F.lit("/"), d.cast("string"))


def _number(x: Column, digits, commas, yen) -> Column:
    text = fixed(x, digits, commas)
    signed = lambda t: F.concat(F.when(x < 0, "-").otherwise(""), F.lit("¥"), F.regexp_replace(t, "^-", ""))
    if isinstance(yen, bool):
        return signed(text) if yen else text
    return let(text, lambda t: F.when(yen, signed(t)).otherwise(t))


def _in_way(way: str, raw: Column, x: Column, p) -> Column:
    """The text of number x in a way; p: a :class:`Shown`, or its fields as columns."""
    match way:
        case "percent":
            return F.concat(_printed(x * 100, p.digits, "f"), F.lit("%"))
        case "apart":
            return F.array_join(F.filter(F.split(raw, ""), lambda c: c != ""), " ")
        case "plain_yen":
            return F.concat(F.lit("¥ "), F.regexp_replace(fixed(x, 0, True), "^-", ""))
        case "scientific":
            return scientific(x, p.digits, p.power)
        case "fraction":
            return fraction(x)
        case "number":
            return _number(x, p.digits, p.commas, p.yen)
    return date_text(x, way)


DATE_WAYS = ("slashes", "month_day", "date", "time", "era", "date_time")
WAYS = (*DATE_WAYS, "percent", "apart", "plain_yen", "scientific", "fraction", "number")


def display(raw: Column, code: str | Column, format_id: int | Column = 0) -> Column:
    """The shown text of a raw value, null where it is shown as it is.  Code and id are literals or columns."""
    if isinstance(code, str):
        return let(_double(raw), lambda x: of(raw, x, shown(code, format_id)))
    return display_struct(raw, shown_of(code, format_id if isinstance(format_id, Column) else F.lit(format_id)))


def _double(raw: Column) -> Column:
    """The number of a raw text; other texts, which are shown as they are, give null."""
    return let(strip(raw), lambda s: F.when(s.rlike(rf"^{DECIMAL}$"), s.try_cast("double")))


def of(raw: Column, x: Column, p: Shown) -> Column:
    """A number x with its raw text, by a format known here: only its own way is in the expression."""
    out = F.lit(None).cast("string") if p.way is None else _in_way(p.way, raw, x, p)
    if p.zero is not None:
        out = F.when(x == 0, F.lit(p.zero)).otherwise(out)
    return F.when(x.isNotNull(), out)


def of_struct(raw: Column, x: Column, p: Column) -> Column:
    """The same by a column of structs."""
    f = Shown(*[p[n] for n in Shown.__dataclass_fields__])
    out = F.when(x.isNull(), F.lit(None).cast("string")).when((x == 0) & f.zero.isNotNull(), f.zero)
    for way in WAYS:
        out = out.when(f.way == way, _in_way(way, raw, x, f))
    return out


def display_struct(raw: Column, p: Column) -> Column:
    """:func:`display` by a struct from :func:`shown_of`."""
    # the struct is made outside of the lambda, which may hold no Python function
    return let(F.struct(raw.alias("raw"), _double(raw).alias("x"), p.alias("p")), lambda v: of_struct(v["raw"], v["x"], v["p"]))


def builtin_code(format_id: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BUILTIN.items() for x in kv]), format_id), F.lit("General"))

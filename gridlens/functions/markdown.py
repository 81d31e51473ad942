"""Markdown text as Spark columns: escaping, normalising, rich text, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import BLANKS, let

INLINE_BLANK = "[" + BLANKS.replace("\\n", "") + "]"
#: Control and format characters that Markdown must not carry.  Fixed values.
UNSAFE = "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F-\\u009F\\u00AD\\u200B-\\u200F\\u2028\\u2029\\u202A-\\u202E\\u2060-\\u206F\\uFEFF\\uFDD0-\\uFDEF\\uFFFE\\uFFFF]"


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def escape(text: Column) -> Column:
    """Text as Markdown that shows it: the backslash first, then entities, marks anywhere, marks at line starts."""
    return _chain(
        F.coalesce(text, F.lit("")), (r"\r\n?", "\n"), (r"\\", r"\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
        (r"([`*_{}\[\]()!|~])", r"\\$1"), (r"(?md)^#", r"\\#"), (rf"(?md)^([-+])(?={INLINE_BLANK})", r"\\$1"),
        (rf"(?md)^([0-9]+)\.(?={INLINE_BLANK})", r"$1\\."),
    )


def escape_line_start(text: Column) -> Column:
    """A line that opens no heading, quote or list."""
    b = f"[{BLANKS}]"
    return _chain(F.coalesce(text, F.lit("")), (rf"^({b}*)([#>])", r"$1\\$2"), (rf"^({b}*)([-+*])({b}+)", r"$1\\$2$3"), (rf"^({b}*)([0-9]+)\.({b}+)", r"$1$2\\.$3"))


def normalize(text: Column) -> Column:
    """One line without control characters."""
    return _chain(F.coalesce(text, F.lit("")), (UNSAFE, " "), (r"\r\n?|\n", " "), (r"\t", " "))


def table_cell(text: Column) -> Column:
    return F.replace(normalize(text), F.lit("|"), F.lit("\\|"))


def heading(text: Column) -> Column:
    return F.regexp_replace(normalize(text), rf"^#+[{BLANKS}]*", "")


def list_item(text: Column) -> Column:
    return F.regexp_replace(normalize(text), rf"^([-*+]|[0-9]+\.)[{BLANKS}]+", "")


def compact(text: Column) -> Column:
    """Escaped, on one line, blanks collapsed, trimmed."""
    return _chain(normalize(escape(text)), (f"[{BLANKS}]+", " "), ("^ | $", ""))


def styled(text: Column, style: Column) -> Column:
    """Text in its marks: underline inside strike inside italic inside bold."""
    out = text
    for flag, before, after in (("underline", "<ins>", "</ins>"), ("strike", "~~", "~~"), ("italic", "*", "*"), ("bold", "**", "**")):
        out = F.when(F.coalesce(style[flag], F.lit(False)), F.concat(F.lit(before), out, F.lit(after))).otherwise(out)
    return F.when(text == "", "").otherwise(out)


def github_run(text: Column, style: Column) -> Column:
    """A run's lines, each escaped and styled, with <br> between them."""
    lines = F.split(_chain(F.coalesce(text, F.lit("")), (r"\r\n?", "\n"), (r"\t", " ")), "\n")
    return F.array_join(F.transform(lines, lambda t: styled(escape(t), style)), "<br>")


def github_text(text: Column, style: Column, runs: Column) -> Column:
    """A cell's text with its styles: of its runs where they make up the text, else of the cell."""
    joined = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    own = F.array_join(F.transform(runs, lambda r: github_run(r["text"], r)), "")
    chosen = F.when(runs.isNotNull() & (compact(text) == compact(joined)), own).otherwise(github_run(text, style))
    return _chain(chosen, (" {2,}", " "), (f"^[{BLANKS}]+|[{BLANKS}]+$", ""))


def merge_runs(runs: Column, cell_style: Column) -> Column:
    """Runs with the cell's styles added, equal neighbours joined, null where nothing is styled."""
    flags = ("bold", "italic", "strike", "underline")
    empty = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean>>")

    def step(done: Column, r: Column) -> Column:
        new = F.struct(r["text"].alias("text"), *[(F.coalesce(r[f], F.lit(False)) | F.coalesce(cell_style[f], F.lit(False))).alias(f) for f in flags])
        last = F.try_element_at(done, F.lit(-1))
        equal = last.isNotNull()
        for f in flags:
            equal = equal & (last[f] == new[f])
        joined = F.struct(F.concat(last["text"], new["text"]).alias("text"), *[new[f].alias(f) for f in flags])
        grown = F.when(F.coalesce(equal, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(new)))
        return F.when(F.coalesce(r["text"], F.lit("")) == "", done).otherwise(grown)

    out = F.aggregate(runs, empty, step)
    any_style = F.exists(out, lambda r: r["bold"] | r["italic"] | r["strike"] | r["underline"])
    return F.when(any_style, out)


def fragment(heading_text: Column) -> Column:
    """The anchor of a heading."""
    return _chain(F.lower(F.regexp_replace(heading_text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")), (r"<[^>]+>", ""), (rf"[^\p{{L}}\p{{N}}{BLANKS}_-]+", ""), (f"[{BLANKS}]+", "-"))


def link(label: Column, url: Column) -> Column:
    """An external link, or the label alone without a target."""
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", label).otherwise(F.concat(F.lit("["), label, F.lit("]("), F.trim(url), F.lit(")")))


def internal_target(location: Column, current_sheet: Column) -> tuple[Column, Column]:
    """(sheet, reference) of an internal link's location."""
    c = F.regexp_replace(F.trim(F.coalesce(location, F.lit(""))), "^#", "")
    rule = r"^(?:'((?:[^']|'')+)'|([^!]+))!(.+)$"
    scoped = c.rlike(rule)
    sheet = F.replace(F.concat(F.regexp_extract(c, rule, 1), F.regexp_extract(c, rule, 2)), F.lit("''"), F.lit("'"))
    return F.when(scoped, sheet).otherwise(current_sheet), F.when(scoped, F.trim(F.regexp_extract(c, rule, 3))).otherwise(c)


def internal_link(label: Column, sheet: Column, ref: Column, known: Column) -> Column:
    """A link to a sheet's heading with its place behind; without such a sheet the label and the place."""
    trace = F.concat_ws("!", F.when(sheet != "", sheet), F.when(ref != "", ref))
    href = F.concat(F.lit("["), label, F.lit("](#"), fragment(sheet), F.lit(")"))
    told = F.concat(F.lit(" ("), trace, F.lit(")"))
    return F.when(known, F.when((trace != "") & (trace != sheet), F.concat(href, told)).otherwise(href)).otherwise(F.when(trace != "", F.concat(label, told)).otherwise(label))


def table(rows: Column, first_is_header: bool = True) -> Column:
    """A Markdown table of array<array<string>>; without a header row the head is blank, and a single header row gets a
    blank body row."""
    def made(rows: Column, width: Column) -> Column:
        padded = lambda cells: F.concat(F.transform(cells, lambda c: table_cell(c)), F.array_repeat(F.lit(""), width - F.size(cells)))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(padded(cells), " | "), F.lit(" |"))
        blank = line(F.array().cast("array<string>"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        if first_is_header:
            head, body = line(rows[0]), F.when(F.size(rows) > 1, F.transform(F.slice(rows, F.lit(2), F.size(rows) - 1), line)).otherwise(F.array(blank))
        else:
            head, body = blank, F.transform(rows, line)
        return F.when(F.size(rows) > 0, F.concat_ws("\n", head, rule, F.array_join(body, "\n"))).otherwise("")

    # the width is known before any row is written: inside a row's expression it would be a pass over all rows
    return let(rows, lambda rows: let(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: made(rows, width)))

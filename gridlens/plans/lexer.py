"""Formula text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

_RULES = [
    ("space", r"\s+"),
    ("string", r'"(?:[^"]|"")*"'),
    ("quoted", r"'(?:[^']|'')*'"),
    ("error", r"#(?i:N/A|REF!|VALUE!|NULL!|NUM!|NAME\?|DIV/0!|CALC!|SPILL!|GETTING_DATA)[A-Za-z0-9/!?#]*"),
    ("number", r"(?:\d+\.\d*|\.\d+|\d+)(?:[Ee][+-]?\d+)?"),
    ("op", r"<>|<=|>=|[-+*/&=<>%#]"),
    ("mark", r"[(),;:{}!\[\]]"),
    ("word", r"[^\W\d]|[\\$]"),
]
_SCAN = re.compile("|".join(f"(?P<{k}>{r})" for k, r in _RULES))
_WORD = re.compile(r"[\w.\\$?]+")
_CELL = re.compile(r"\$?[A-Za-z]{1,3}\$?\d+$")
_OPENS = re.compile(r"['(\\$]|[^\W\d]")


class FormulaError(ValueError):
    """The text is not a formula of this language."""


@dataclass(frozen=True)
class Token:
    kind: str  # string quoted error number op mark cell name bool
    value: str


def tokens(source: str) -> list[Token]:
    """Tokens of a formula, with or without its leading ``=``.  Blanks between two references are the operator ``" "``."""
    text, at, out = source.removeprefix("="), 0, []
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "word":
            value = _WORD.match(text, at)[0]
            kind = "bool" if value.upper() in ("TRUE", "FALSE") else "cell" if _CELL.match(value) else "name"
        at += len(value)
        if kind == "space":
            joins = out and (out[-1].kind in ("cell", "name", "quoted") or out[-1].kind == "mark" and out[-1].value in ")]}")
            if joins and _OPENS.match(text, at):
                out.append(Token("op", " "))
        elif kind in ("string", "quoted"):
            out.append(Token(kind, value[1:-1].replace(value[0] * 2, value[0])))
        else:
            out.append(Token(kind, value))
    return out

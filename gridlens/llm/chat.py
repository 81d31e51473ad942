"""Chat formatting: a declarative template, a finite-state machine over roles, segments with loss flags.

The template names the marks of each role, the end mark and the legal turn order.  Every control string opens with a
character that texts carry only escaped, so the output can be read back exactly (:class:`Reader`).

How it scales: the state after a turn is its role, so a turn needs only its predecessor.  A conversation of more than
``CHUNK`` turns is cut at quantiles of ``turn`` (mergeable sketches, no sort), windows run inside (conversation, chunk),
and each chunk takes its entry state and offsets from sums over chunks.  Turns that are equal or null stay in one chunk.
A digest of a conversation (:func:`read_back`) takes its bytes in order, in one task, streaming.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000
CUTS = 1_024
START, OTHER = "<start>", "<other>"


@dataclass(frozen=True)
class Template:
    """marks: opening string by role.  other: opening and closing string around a role that has no mark of its own.
    legal: roles that may follow a state (a role, or START).  final: roles that may end.  loss: roles to learn."""

    marks: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: tuple[str, str] = ("### [", "]: ")
    end: str = "</turn>\n"
    escape: str = "\\"
    legal: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        opening = [*self.marks.values(), self.other[0]]
        controls = [*opening, self.other[1], self.end]
        if len(self.escape) != 1 or not all(controls) or any(self.escape in c for c in controls):
            raise ValueError("control strings must not be empty or hold the escape character")
        if any(a != b and b.startswith(a) for a in opening for b in opening):
            raise ValueError("no opening string may begin another")

    @property
    def special(self) -> str:
        """The characters that texts and role names carry only behind the escape character."""
        return "".join(sorted({self.escape, *(c[0] for c in [*self.marks.values(), *self.other, self.end])}))

    def escaped(self, text: Column) -> Column:
        chars = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in self.special)
        mark = "\\" + self.escape if self.escape in "\\$" else self.escape  # as Java's replacement strings have it
        return F.regexp_replace(text, f"([{chars}])", mark + "$1")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(F.coalesce(role, F.lit(""))), F.lit(self.other[1]))
        for r, m in self.marks.items():
            out = F.when(role == r, F.lit(m)).otherwise(out)
        return out


DEFAULT = Template()


def format_turns(turns: DataFrame, template: Template = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """One row a turn of ``turns(conv_id, turn, role, text)``: conv_id, turn_no, role, state_before, valid,
    segments array<struct<text, loss>>, first_char, chars.

    The segments of a conversation in order of turn_no (from 0), joined, are its formatted text; first_char is the
    turn's offset in it, in code points.  Turns go by (turn, role, text), nulls first; equal rows stay as turns of their
    own.  A null text is empty; a null or unknown role gets the mark for others and is never valid; valid tells whether
    the role may follow the state before it and, in the last turn, may end a conversation.  Nothing is dropped: the
    machine goes on from the turn's role.  Null conv_ids form one conversation.  An empty table gives an empty table.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # cuts only for conversations longer than a chunk, at most rows / chunk of them; up to CUTS chunks each, then longer ones
    large = t.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(F.col("conv_id").alias("large_id"))
    cuts = t.select("conv_id", "turn").join(large, F.col("conv_id").eqNullSafe(F.col("large_id")), "left_semi")
    cuts = cuts.groupBy(F.col("conv_id").alias("cut_id")).agg(F.array_distinct(F.percentile_approx("turn", [i / CUTS for i in range(1, CUTS)], 20 * CUTS)).alias("cuts"))
    t = t.join(cuts, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left").drop("cut_id")
    t = t.withColumn("chunk", F.when(F.col("cuts").isNull() | F.col("turn").isNull(), F.lit(-1)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("turn"))))).drop("cuts")
    learn = F.coalesce(F.col("role").isin(*template.loss), F.lit(False))
    t = t.withColumn("segments", F.array(
        F.struct(template.opening(F.col("role")).alias("text"), F.lit(False).alias("loss")),
        F.struct(template.escaped(F.col("text")).alias("text"), learn.alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    ))
    t = t.withColumn("chars", sum((F.char_length(F.col("segments")[i]["text"]) for i in range(3)), F.lit(0)).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    known = F.when(F.col("role").isin(*template.marks), F.col("role")).otherwise(F.lit(OTHER))
    t = t.withColumn("state", known)
    t = t.withColumns({
        "no": F.row_number().over(inside) - 1, "before": F.lag("state").over(inside),
        "at": F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.lead("state").over(inside),
    })
    ends = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("chars").alias("all"), F.max(F.when(F.col("after").isNull(), F.struct("no", "state")))["state"].alias("last"))
    over = Window.partitionBy("conv_id").orderBy("chunk")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col("conv_id").alias("e_conv"), F.col("chunk").alias("e_chunk"), F.lag("last").over(over).alias("entry"),
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base_no"), F.coalesce(F.sum("all").over(past), F.lit(0)).alias("base_at"),
        F.lead("chunk").over(over).isNull().alias("is_last"),
    )
    t = t.join(ends, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("chunk") == F.col("e_chunk")))
    state = F.coalesce("before", "entry", F.lit(START))
    legal = F.lit(False)
    for s, roles in template.legal.items():
        legal = legal | ((state == s) & F.col("state").isin(*roles))
    last = F.col("is_last") & F.col("after").isNull()
    return t.select(
        "conv_id", (F.col("base_no") + F.col("no")).cast("long").alias("turn_no"), "role", state.alias("state_before"),
        (legal & (~last | F.col("state").isin(*template.final))).alias("valid"), "segments",
        (F.col("base_at") + F.coalesce("at", F.lit(0))).cast("long").alias("first_char"), "chars",
    )


class Reader:
    """Reads turns back from formatted text, given in pieces that each end where a turn ends."""

    def __init__(self, template: Template = DEFAULT):
        self.template = template
        controls = sorted([*template.marks.values(), template.other[0]], key=len, reverse=True)
        self.open = re.compile("|".join(map(re.escape, controls)))
        self.role = {m: r for r, m in template.marks.items()}
        self.plain = re.compile(re.escape(template.escape) + "(.)", re.S)

    def unescape(self, text: str) -> str:
        return self.plain.sub(r"\1", text)

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        at = 0
        while at < len(text):
            m = self.open.match(text, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            at, role = m.end(), self.role.get(m[0])
            if role is None:
                r = self._body(text, at, self.template.other[1])
                role, at = self.unescape(text[at:r]), r + len(self.template.other[1])
            end = self._body(text, at, self.template.end)
            yield role, self.unescape(text[at:end])
            at = end + len(self.template.end)

    def _body(self, text: str, at: int, close: str) -> int:
        """Where the first unescaped close begins; escapes are skipped two characters at a time."""
        esc, end = self.template.escape, text.find(close, at)
        while end >= 0:
            back = text.find(esc, at, end)
            if back < 0:
                return end
            at = back + 2
            if at > end:
                end = text.find(close, at)
        raise ValueError("a turn does not end")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests by conversation, from the output of :func:`format_turns` alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, all_valid.

    Turns stream through their task in order, one held at a time: a hash of a conversation takes its bytes in order.
    """
    reader = Reader(template)

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, out = None, []

        def done():
            return (key[0], n, every.hexdigest(), chars, loss.hexdigest(), total, valid)

        for f in frames:
            for conv, segments, ok in zip(f["conv_id"].tolist(), f["segments"].tolist(), f["valid"].tolist(), strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if key is None or key[0] != conv:
                    if key is not None:
                        out.append(done())
                    key, n, chars, total, valid = (conv,), 0, 0, 0, True
                    every, loss = hashlib.sha256(), hashlib.sha256()
                text = "".join(s["text"] for s in segments)
                for role, body in reader.turns(text):
                    n += 1
                    every.update(f"{role}\n{body}\n".encode())
                learnt = "".join(reader.unescape(s["text"]) for s in segments if s["loss"])
                loss.update(learnt.encode())
                chars, total, valid = chars + len(learnt), total + len(text), valid and bool(ok)
            if len(out) >= 5000:
                yield frame(out)
                out = []
        if key is not None:
            out.append(done())
        yield frame(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "all_valid"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "turn_no", "segments", "valid")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInPandas(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, all_valid boolean"
    )

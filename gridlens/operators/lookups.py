"""Spreadsheet lookups as joins.

The searched table has a position, a key and result columns.  First and last matches are ``min_by`` and ``max_by`` over
positions, so the table need not be sorted and is reduced before the join.  Approximate matches go by position, not by
key: the result is the last row whose key is not above the wanted one, unless a row matches exactly.

Small tables are folded into array literals.  Larger ones meet the distinct wanted keys in ranges of keys (:func:`_carried`):
windows run inside a range, one row a range carries on what came before it, and the answers join back, so neither side has
to fit anywhere and a wanted key that a third of all rows ask for is answered once.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

MISSING = "#N/A"
#: Rows of a searched table up to which it is folded into literals.
SMALL_TABLE = 10_000
RANGE = 100_000  # distinct keys a range, about
MOST_RANGES = 20_000


def with_position(table: DataFrame, *order: str) -> DataFrame:
    """``table`` with ``pos`` from 1 in the given order, by range partitions: no window over the whole table.  The numbers within
    partitions are written once: ranges are sampled and partitions coalesced anew wherever a plan computes them again."""
    ranked = table.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()), "positions")
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", "_first", before.alias("_before"))
    return ranked.join(F.broadcast(counts), "_part").withColumn("pos", F.col("_before") + F.col("_in") - F.col("_first") + 1).drop("_part", "_in", "_before", "_first")


def exact(left: DataFrame, key: Column, table: DataFrame, table_key: str, result: str, name: str, position: str = "pos", last: bool = False, missing: object = MISSING) -> DataFrame:
    """``left`` with ``name``: the result of the first (or last) row of the table with the key.  The table is reduced to one
    row a key, so the join never multiplies rows."""
    pick = F.max_by if last else F.min_by
    one = table.groupBy(F.col(table_key).alias("_key")).agg(pick(F.col(result), F.col(position)).alias("_result"))
    return left.join(one, key == F.col("_key"), "left").withColumn(name, F.coalesce(F.col("_result").cast("string"), F.lit(missing))).drop("_key", "_result")


def match(left: DataFrame, key: Column, table: DataFrame, table_key: str, name: str, position: str = "pos") -> DataFrame:
    """Position of the first row with the key, #N/A without."""
    one = table.groupBy(F.col(table_key).alias("_key")).agg(F.min(position).alias("_pos"))
    return left.join(one, key == F.col("_key"), "left").withColumn(name, F.coalesce(F.col("_pos").cast("string"), F.lit(MISSING))).drop("_key", "_pos")


def index(left: DataFrame, at: Column, table: DataFrame, result: str, name: str, position: str = "pos") -> DataFrame:
    """The result at a position (at least 1), null outside the table."""
    one = table.select(F.col(position).alias("_pos"), F.col(result).alias("_result"))
    return left.join(one, F.when(at.isNotNull(), F.greatest(F.floor(at), F.lit(1))) == F.col("_pos"), "left").withColumn(name, F.col("_result")).drop("_pos", "_result")


def _small(table: DataFrame, key: str, result: str, position: str, most: int) -> list | None:
    """The table's (k, v, p) rows by position, or None if it has more than ``most``."""
    rows = table.select(F.col(key).cast("double").alias("k"), F.col(result).cast("string").alias("v"), F.col(position).alias("p")).limit(most + 1).collect()
    return None if len(rows) > most else sorted(rows, key=lambda r: r.p)


def _literal(values: list, kind: str) -> Column:
    """An array constant, by one expression whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def approximate(left: DataFrame, key: Column, table: DataFrame, table_key: str, result: str, name: str, mode: int = -1, last: bool = False, position: str = "pos", missing: object = MISSING, small: int = SMALL_TABLE) -> DataFrame:
    """``left`` with ``name`` by an approximate match; the table may be unsorted and of any size.

    An exact match counts first (the last one if ``last``).  mode -1: else the highest position whose key is not above;
    mode 1: else the first (``last``: last) position whose key is not below.  Null keys match nothing.  A table of at most
    ``small`` rows is folded into a literal, so ``left`` is neither shuffled nor multiplied; a larger one goes by ranges.
    """
    steps = _small(table, table_key, result, position, small)
    if steps is None:
        return _approximate_by_ranges(left, key, table, table_key, result, name, mode, last, position, missing)
    # the answer depends on the key's place among the sorted distinct keys: one interval lookup by bisection of literals
    keys = sorted({r.k for r in steps if r.k is not None})
    if not keys:
        return left.withColumn(name, F.lit(missing))

    def answer(x: float, equal: bool):
        rows = steps[::-1] if last else steps
        hit = next((r for r in rows if equal and r.k == x), None)
        if hit is None and mode == -1:
            hit = next((r for r in steps[::-1] if r.k is not None and r.k <= x), None)
        if hit is None and mode == 1:
            hit = next((r for r in rows if r.k is not None and (r.k >= x if equal else r.k > x)), None)
        return missing if hit is None or hit.v is None else hit.v

    at = [answer(k, True) for k in keys]  # on the keys
    below = [missing if mode == -1 else answer(float("-inf"), False), *[answer(k, False) for k in keys]]  # between them
    arr = _literal(keys, "double")
    n = F.size(F.filter(arr, lambda k: k < key)) if len(keys) <= 64 else _bisect(arr, key, len(keys))
    on = F.coalesce(F.try_element_at(arr, n + 1) == key, F.lit(False))
    out = F.when(on, F.element_at(_literal(at, "string"), F.least(n + 1, F.lit(len(at))))).otherwise(F.element_at(_literal(below, "string"), n + 1))
    return left.withColumn(name, F.when(key.isNull(), F.lit(missing)).otherwise(out))


def _approximate_by_ranges(left, key, table, table_key, result, name, mode, last, position, missing) -> DataFrame:
    row = F.struct(F.col(position).alias("p"), F.col(result).cast("string").alias("v"))
    steps = table.groupBy(F.col(table_key).cast("double").alias("k")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    exact = F.col("last" if last else "first")
    pick = "last" if mode == -1 or last else "first"
    asked = left.select(key.cast("double").alias("k"))
    found = _carried(asked, steps.select("k", exact.alias("here"), F.col(pick).alias("step")), [], mode == 1, pick == "last")
    answers = found.select(F.col("k").alias("_k"), F.coalesce("here", "best")["v"].alias("_v"))
    return left.join(answers, key.cast("double") == F.col("_k"), "left").withColumn(name, F.coalesce("_v", F.lit(missing))).drop("_k", "_v")


def _carried(asked: DataFrame, steps: DataFrame, by: list[str], down: bool, largest: bool) -> DataFrame:
    """For each distinct row of ``asked(*by, k)``: ``here``, what ``steps(*by, k, here, step)`` has at its key, and ``best``, the
    largest (or least) step at keys up to it (``down``: from it on).  Null keys are left out."""
    nothing = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in ("here", "step")]
    both = steps.select(*by, "k", "here", "step", F.lit(False).alias("asked")).union(asked.select(*by, "k").distinct().select(*by, "k", *nothing, F.lit(True)))
    both = both.where("k is not null").groupBy(*by, "k").agg(F.first("here", True).alias("here"), F.first("step", True).alias("step"), F.bool_or("asked").alias("asked"))
    both = written(both, "lookup")
    n = both.count()
    ranges = min(MOST_RANGES, math.ceil(n / RANGE))
    bounds = both.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds))
    both = both.withColumn("range", _bisect(_literal(bounds, "double"), F.col("k"), len(bounds)) if bounds else F.lit(0))
    best, either = (F.max, F.greatest) if largest else (F.min, F.least)
    order = lambda c: F.desc(c) if down else F.asc(c)
    inside = Window.partitionBy(*by, "range").orderBy(order("k")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(order("range")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range (at most MOST_RANGES for one value of ``by``)
    carry = both.groupBy(*by, "range").agg(best("step").alias("total")).withColumn("carry", best("total").over(earlier))
    carry = carry.select(*[F.col(c).alias(f"c_{c}") for c in by], F.col("range").alias("c_range"), "carry")
    same = F.col("range") == F.col("c_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    out = both.withColumn("own", best("step").over(inside)).where("asked").join(carry, same)
    return out.select(*by, "k", "here", either("own", "carry").alias("best"))


def _bisect(arr: Column, key: Column, n: int) -> Column:
    """How many of the n sorted keys are below, in log n steps."""
    state = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce(F.try_element_at(arr, middle + 1) < key, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), state, step, lambda s: s["low"])


def sorted_asof(left: DataFrame, left_key: str, table: DataFrame, table_key: str, result: str, name: str, by: list[str] | None = None, missing: object = MISSING) -> DataFrame:
    """Approximate match against a sorted table of any size: the row of the largest key not above, within equal values of the
    columns ``by`` (null equals null).  Of rows with one key the largest result counts; null keys match nothing.  Wanted keys
    meet the table in ranges of keys, with or without ``by``; rows of ``left`` join their answer."""
    by = by or []
    row = F.struct(F.col(table_key).cast("double").alias("p"), F.col(result).cast("string").alias("v"))
    steps = table.groupBy(*by, F.col(table_key).cast("double").alias("k")).agg(F.max(row).alias("step"))
    found = _carried(left.select(*by, F.col(left_key).cast("double").alias("k")), steps.select(*by, "k", F.col("step").alias("here"), "step"), by, False, True)
    answers = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("k").alias("_k"), F.col("best.v").alias("_v"))
    same = F.col(left_key).cast("double") == F.col("_k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(answers, same, "left").withColumn(name, F.coalesce("_v", F.lit(missing))).drop("_k", "_v", *[f"_by_{c}" for c in by])


# ---------------------------------------------------------------- binary search


def binary(left: DataFrame, key: Column, table: DataFrame, table_key: str, result: str, name: str, match: int = 0, descending: bool = False, position: str = "pos", missing: object = MISSING, small: int = SMALL_TABLE) -> DataFrame:
    """``left`` with ``name`` by literal binary search over positions 1 to n of the table, without gaps: on unsorted keys the
    outcome follows the probes.  match -1: else the largest probed key not above, 1: else the least one not below.  Null
    keys of the table count as 0; a null wanted key matches nothing.

    The probes of the first levels are the same for all: they are an array literal.  In a table of more than ``small`` rows a
    wanted key then goes on in its block of about n / ``small`` successive positions, which it joins.
    """
    rows = table.select((F.col(position) - 1).cast("long").alias("i"), F.coalesce(F.col(table_key).cast("double"), F.lit(0.0)).alias("k"), F.col(result).cast("string").alias("v"))
    n = rows.count()
    depth = min(n, small).bit_length()
    spans = [(0, n - 1)]  # the part of the table at each node of the tree of probes, children of node j at 2j + 1 and 2j + 2
    for j in range(2**depth - 1):
        low, high = spans[j]
        middle = (low + high) // 2
        spans += [(low, middle - 1), (middle + 1, high)] if low <= high else [(1, 0), (1, 0)]
    probes = {(low + high) // 2: j for j, (low, high) in enumerate(spans[: 2**depth - 1]) if low <= high}
    tops: list[float] = [0.0] * (2**depth - 1)
    at = F.broadcast(left.sparkSession.createDataFrame([(i,) for i in probes], "i long"))  # at most 2 * small rows
    for r in rows.join(at, "i").select("i", "k").collect():
        tops[probes[r.i]] = r.k
    x = F.col("x")
    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(n - 1).cast("long").alias("high"), F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("best"), F.lit(0.0).alias("best_key"), F.lit(-1).cast("long").alias("hit"))
    asked = left.select(key.cast("double").alias("x")).where("x is not null").distinct()
    asked = asked.withColumn("s", _probed(start, x, depth, match, descending, lambda s, middle: F.try_element_at(_literal(tops, "double"), (s["node"] + 1).cast("int"))) if n else start)
    if n >= 2**depth:  # nodes of the last level have a block of rows left
        blocks = [(j - (2**depth - 1), *spans[j]) for j in range(2**depth - 1, 2 ** (depth + 1) - 1) if spans[j][0] <= spans[j][1]]
        lows = _literal([float(low) for _, low, _ in blocks], "double")
        own = _literal([b for b, *_ in blocks], "long")
        which = _bisect(lows, F.col("i") + F.lit(0.5), len(blocks))
        body = rows.withColumn("block", F.element_at(own, F.greatest(which, F.lit(1)))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "k"))).alias("b"))
        body = body.select("block", F.transform("b", lambda r: r["k"]).alias("keys"), F.col("b")[0]["i"].alias("from"))
        asked = asked.withColumn("block", F.when((F.col("s.hit") < 0) & (F.col("s.low") <= F.col("s.high")), F.col("s.node") - (2**depth - 1))).join(body, "block", "left")
        rounds = max(high - low + 1 for _, low, high in blocks).bit_length()
        in_block = lambda s, middle: F.try_element_at("keys", (middle - F.col("from") + 1).cast("int"))
        asked = asked.withColumn("s", F.when(F.col("block").isNotNull(), _probed(F.col("s"), x, rounds, match, descending, in_block)).otherwise(F.col("s"))).select("x", "s")
    place = F.when(F.col("s.hit") >= 0, F.col("s.hit")).when(F.col("s.best") >= 0, F.col("s.best"))
    answers = asked.withColumn("i", place).join(rows.select("i", "v"), "i").select(F.col("x").alias("_x"), F.col("v").alias("_v"))
    return left.join(answers, key.cast("double") == F.col("_x"), "left").withColumn(name, F.coalesce("_v", F.lit(missing))).drop("_x", "_v")


def _probed(start: Column, x: Column, rounds: int, match: int, descending: bool, key_at) -> Column:
    """The state of a binary search after so many probes."""

    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2)
        k = key_at(s, middle)
        on = (s["low"] <= s["high"]) & (s["hit"] < 0)
        equal = on & (k == x)
        right = (k < x) != F.lit(descending)
        better = F.lit(False)
        if match:
            better = on & ((k <= x) if match == -1 else (k >= x)) & ((s["best"] < 0) | ((k > s["best_key"]) if match == -1 else (k < s["best_key"])))
        return F.struct(
            F.when(on & ~equal & right, middle + 1).otherwise(s["low"]).alias("low"), F.when(on & ~equal & ~right, middle - 1).otherwise(s["high"]).alias("high"),
            F.when(on & ~equal, 2 * s["node"] + F.when(right, 2).otherwise(1)).otherwise(s["node"]).alias("node"),
            F.when(better, middle).otherwise(s["best"]).alias("best"), F.when(better, k).otherwise(s["best_key"]).alias("best_key"),
            F.when(equal, middle).otherwise(s["hit"]).alias("hit"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step) if rounds else start


def wildcard_pattern(pattern: str) -> str:
    """A regular expression for ``*``, ``?`` and ``~`` escapes, without case."""
    parts = re.findall(r"(?s)~.|.", pattern)
    one = lambda p: ".*" if p == "*" else "." if p == "?" else re.sub(r"([^\w\s])", r"\\\1", p[1:] if len(p) == 2 else p)
    return "(?is)^" + "".join(map(one, parts)) + "$"


def wildcard(table: DataFrame, key: str, result: str, patterns: list[str], position: str = "pos", last: bool = False) -> DataFrame:
    """(pattern, result) for each pattern: exact match first, then the first (or last) key that it fits.  All patterns in one
    pass over the table: conditional aggregates, no join."""
    pick = F.max_by if last else F.min_by
    aggs = []
    for i, p in enumerate(patterns):
        for kind, test in (("e", F.col(key) == p), ("w", F.col(key).rlike(wildcard_pattern(p)))):
            aggs.append(pick(F.when(test, F.col(result).cast("string")), F.when(test, F.col(position))).alias(f"{kind}{i}"))
    one = table.agg(*aggs)
    rows = [F.struct(F.lit(p).alias("pattern"), F.coalesce(f"e{i}", f"w{i}", F.lit(MISSING)).alias("result")) for i, p in enumerate(patterns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def horizontal(table: DataFrame, header: dict[str, object], result: dict[str, str]) -> DataFrame:
    """A header row and a result row, column by column, as a table (pos, key, result) for the lookups above."""
    parts = [F.struct(F.lit(i).alias("pos"), F.lit(k).cast("string").alias("key"), F.col(result[c]).cast("string").alias("result")) for i, (c, k) in enumerate(header.items(), 1)]
    return table.select(F.explode(F.array(*parts)).alias("t")).select("t.*")

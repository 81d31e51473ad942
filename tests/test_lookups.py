import random

import pytest
from gridlens.functions import scalars
from gridlens.operators import lookups
from pyspark.sql import functions as F


@pytest.mark.parametrize(("n", "small"), [(5, 100), (100, 100), (100, 99)])
@pytest.mark.parametrize(("mode", "last"), [(-1, False), (1, False), (-1, True), (1, True)])
def test_approximate_matches_by_position(spark, mode, last, n, small, monkeypatch):
    """Unsorted tables with repeated keys, against the scan that a spreadsheet makes."""
    monkeypatch.setattr(lookups, "RANGE", 20)
    rng = random.Random(n)
    steps = [(i + 1, float(rng.randint(0, 60)), f"v{i}") for i in range(n)]
    asked = [float(x) / 2 for x in range(-4, 140)] + [None]
    table = spark.createDataFrame(steps, "pos int, k double, v string")
    left = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, x double")
    got = {r.i: r.r for r in lookups.approximate(left, F.col("x"), table, "k", "v", "r", mode, last, small=small).collect()}
    for i, x in enumerate(asked):
        want = "#N/A" if x is None else scalars.xlookup(x, [k for _, k, _ in steps], [v for *_, v in steps], "#N/A", mode, -1 if last else 1)
        assert got[i] == want


def test_exact_first_last_and_missing(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "pos int, k string, v string")
    left = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "q string")
    run = lambda **o: [r.r for r in lookups.exact(left, F.col("q"), table, "k", "v", "r", **o).orderBy(F.col("q").asc_nulls_last()).collect()]
    assert run() == ["x", "y", "#N/A", "#N/A"] and run(last=True, missing="none") == ["z", "y", "none", "none"]
    assert [r.m for r in lookups.match(left, F.col("q"), table, "k", "m").orderBy(F.col("q").asc_nulls_last()).collect()] == ["1", "2", "#N/A", "#N/A"]


@pytest.mark.parametrize("small", [100, 7, 1])
@pytest.mark.parametrize(("match", "descending"), [(0, False), (-1, False), (1, False), (0, True), (-1, True), (1, True)])
def test_binary_search_probes(spark, match, descending, small):
    """Sorted and unsorted tables, against the plain search."""
    for n, mixed in ((0, False), (1, False), (33, False), (60, True)):
        rng = random.Random(n)
        keys = [float(rng.randint(0, 50)) for _ in range(n)]
        keys = keys if mixed else sorted(keys, reverse=descending)
        table = spark.createDataFrame([(i + 1, k, f"v{i}") for i, k in enumerate(keys)], "pos int, k double, v string")
        asked = [x / 2 for x in range(-3, 108, 3)]
        left = spark.createDataFrame([(i, x) for i, x in enumerate([*asked, None])], "i int, x double")
        got = {r.i: r.r for r in lookups.binary(left, F.col("x"), table, "k", "v", "r", match, descending, small=small).collect()}
        for i, x in enumerate(asked):
            assert got[i] == scalars.xlookup(x, keys, [f"v{i}" for i in range(n)], "#N/A", match, -2 if descending else 2)
        assert got[len(asked)] == "#N/A"


def test_sorted_asof_by_groups(spark, monkeypatch):
    monkeypatch.setattr(lookups, "RANGE", 5)
    rng = random.Random(5)
    table = [(g, float(rng.randint(0, 50)), f"v{i}") for i, g in enumerate(["a", "b", None] * 15)]
    asks = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, float(rng.randint(-5, 60))])) for i in range(150)]
    got = {r.i: r.r for r in lookups.sorted_asof(spark.createDataFrame(asks, "i int, g string, x double"), "x", spark.createDataFrame(table, "g string, k double, v string"), "k", "v", "r", ["g"]).collect()}
    for i, g, x in asks:
        fits = [(k, v) for h, k, v in table if h == g and x is not None and k <= x]
        assert got[i] == (max(fits)[1] if fits else "#N/A")


def test_sorted_asof_equals_approximate(spark):
    rng = random.Random(2)
    table = spark.createDataFrame([(float(k), f"v{k}") for k in range(0, 100, 7)], "k double, v string")
    left = spark.createDataFrame([(i, rng.uniform(-5, 120)) for i in range(200)], "i int, x double")
    got = {r.i: r.r for r in lookups.sorted_asof(left, "x", table, "k", "v", "r").collect()}
    for r in left.collect():
        assert got[r.i] == ("#N/A" if r.x < 0 else f"v{min(98, int(r.x // 7) * 7)}")


def test_positions_wildcards_and_rows(spark):
    df = spark.createDataFrame([(x,) for x in "dacb"], "k string")
    assert [(r.k, r.pos) for r in lookups.with_position(df, "k").orderBy("pos").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    table = spark.createDataFrame([(1, "Red ring", "1"), (2, "red*", "2"), (3, "blue ring", "3")], "pos int, k string, v string")
    got = {r.pattern: r.result for r in lookups.wildcard(table, "k", "v", ["RED*", "red~*", "b?ue*", "red*", "x*"]).collect()}
    assert got == {"RED*": "1", "red~*": "2", "b?ue*": "3", "red*": "2", "x*": "#N/A"}
    row = spark.createDataFrame([("p", "q")], "a string, b string")
    across = lookups.horizontal(row, {"a": 10, "b": 20}, {"a": "a", "b": "b"})
    assert [tuple(r) for r in across.orderBy("pos").collect()] == [(1, "10", "p"), (2, "20", "q")]

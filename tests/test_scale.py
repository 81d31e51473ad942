"""What goes wrong only on larger tables, shown on small ones."""

import random
import time
from contextlib import contextmanager

import duckdb
from gridlens import catalog
from gridlens.functions import formats, markdown
from gridlens.operators import lookups, shapes
from gridlens.plans import evaluate
from pyspark.sql import functions as F


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def equals_sql(spark, name, folder, *tables):
    """Whether a query's rows are its SQL's, over the tables in a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, str(folder)).select(*want.columns).toPandas()
    rows = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).values.tolist()))
    assert rows(got) == rows(want) and len(got)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, folder, n=40):
    rng = random.Random(7)
    at = [(rng.randrange(0, 30_000_000), rng.randrange(-3_000_000, 9_000_000)) for _ in range(n)]
    rows = [(i % 2, i, x, y, x + rng.randrange(1, 9_000_000), y + rng.randrange(1, 4_000_000)) for i, (x, y) in enumerate(at)]
    spark.createDataFrame(rows, "s int, no int, left long, top long, right long, bottom long").write.parquet(f"{folder}/boxes")
    return rows, spark.read.parquet(f"{folder}/boxes")


def test_gap_edges_are_not_broadcast(spark, tmp_path):
    """Boxes times squares were: their estimated size is that of the boxes."""
    rows, df = boxes(spark, tmp_path)
    edges = shapes.gap_edges(df, ["s"])
    assert "Broadcast" not in plan(edges)

    def near(a, b):
        dx, dy = max(0, b[2] - a[4], a[2] - b[4]), max(0, b[3] - a[5], a[3] - b[5])
        return a[0] == b[0] and a[1] < b[1] and dx <= shapes.GAP_X and dy <= shapes.GAP_Y

    assert sorted(map(tuple, edges.collect())) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if near(a, b))


def test_blocks_are_not_broadcast(spark, tmp_path):
    rows, df = boxes(spark, tmp_path)
    blocks = shapes.blocks(df, ["s"])
    assert "Broadcast" not in plan(blocks)
    assert sorted(n for b in blocks.collect() for n in b.shapes) == [r[1] for r in rows]


def test_positions_where_partitions_coalesce(spark):
    """Partitions of the wide rows and of their counts coalesce differently."""
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="256k", spark__sql__adaptive__coalescePartitions__parallelismFirst="false", spark__sql__shuffle__partitions="8"):
        wide = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.concat_ws("", *[F.md5(F.concat("id", F.lit(i))) for i in range(4)]).alias("text"))
        got = lookups.with_position(wide, "k").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == F.col("k") + 1).alias("right"), F.max("text")).first()
    assert (got.n, got.right) == (20_000, 20_000)


def test_workbooks_stay_whole_where_joins_are_replanned(spark):
    """The parts of the union are dealt by workbook already, and adaptive execution then joins them by broadcast."""
    n = spark.range(3000).select((F.col("id") % 100).cast("string").alias("workbook"), F.floor(F.col("id") / 100).cast("int").alias("row"))
    no = F.lit(None).cast("string")
    given = n.groupBy("workbook", "row").agg(F.lit(1).alias("col"), F.max("row").cast("string").alias("value")).withColumn("formula", no)
    sums = n.groupBy("workbook", "row").agg(F.lit(2).alias("col")).select("workbook", "row", "col", no.alias("value"), F.lit("=SUM(A1:A29)").alias("formula"))
    cells = given.unionByName(sums).where("row > 0").select("workbook", F.lit(0).alias("sheet_index"), F.lit("S").alias("sheet_name"), F.lit(0).alias("ord"), "row", "col", "formula", F.col("formula").isNotNull().alias("pending"), F.lit(False).alias("empty"), "value")
    names = spark.createDataFrame([], "workbook string, sheet string, name string, formula string")
    tables = spark.createDataFrame([], "workbook string, sheet string, name string, start string, end string, columns array<string>, header_rows int, totals_rows int")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="10m", spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = evaluate.resolve(cells, names, tables).select("resolved").collect()
    assert len(got) == 2900 and {r.resolved for r in got} == {"435"}


def test_large_sums_are_written_without_an_exponent(spark, tmp_path):
    rows = [(i, f"Customer#{i}", i % 2, 9_999_999.25 + i, "MACHINERY") for i in range(6)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    equals_sql(spark, "workbook_formulas", tmp_path, "customer")


def test_balances_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """None of the 15,000 balances of sf0.1 lies between -0.05 and 0."""
    balances = [-0.01, -0.04, -0.05, -0.06, 0.0, -0.0, 0.04, 0.05, -1234.56, 1234.55, -758.25]
    rows = [(i, f"Customer#{i}", i % 2, x, "MACHINERY") for i, x in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    equals_sql(spark, "workbook_cells", tmp_path, "customer")


def test_negative_zeros_are_as_in_sql(spark, tmp_path):
    """A balance of -0.0 has a sign where the SQL formats it, and none where the SQL takes sign() of it."""
    balances = [-0.0, 0.0, -0.01, -0.0, 12.5, -0.0, -758.25, 0.01]
    rows = [(i, f"Customer#{i}", i % 2, x, "MACHINERY") for i, x in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("workbook_end_to_end", "workbook_archives", "workbook_links", "workbook_matrices"):
        equals_sql(spark, name, tmp_path, "customer")


def test_negative_zeros_by_format(spark):
    cases = [("-0.0", "#,##0.00", "-0.00"), ("-0", "0", "-0"), ("0.0", "0.00", "0.00"), ("-0.0", '"¥"#,##0', "¥0"), ("-0.0", '0.0;-0.0;"-"', "-"), ("-0.0", "0.00000000", "-0.00000000")]
    for raw, code, want in cases:
        literal, column = formats.display(F.lit(raw), code), formats.display(F.lit(raw), F.lit(code), F.lit(0))
        assert tuple(spark.range(1).select(literal.alias("x"), column.alias("y")).first()) == (want, want)


def test_signs_of_zero_by_format(spark):
    cases = [("-0.04", "#,##0.0", "-0.0"), ("-0.4", "0", "-0"), ("-0.05", "0.0", "-0.1"), ("0.04", "0.0", "0.0"), ("0", "0.00", "0.00"), ("-0.0000000004", "0.00000000", "-0.00000000"), ("-1234.5", "#,##0", "-1,235")]
    for raw, code, want in cases:
        literal, column = formats.display(F.lit(raw), code), formats.display(F.lit(raw), F.lit(code), F.lit(0))
        assert tuple(spark.range(1).select(literal.alias("x"), column.alias("y")).first()) == (want, want)


def test_long_tables_are_written_in_linear_time(spark):
    """The width was looked for among all rows again for each row."""
    n = 30_000
    rows = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(i.cast("string"), F.lit("x")))
    began = time.time()
    text = spark.range(1).select(rows.alias("rows")).select(markdown.table(F.col("rows")).alias("t")).first().t
    assert text.split("\n")[:3] == ["| 1 | x |", "| --- | --- |", "| 2 | x |"] and text.endswith(f"| {n} | x |") and text.count("\n") == n
    assert time.time() - began < 10

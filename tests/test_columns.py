import pytest
from gridlens.functions import address, coerce, formats, markdown
from gridlens.functions.library import AGGREGATES, SCALARS, Unsupported, register_sql
from gridlens.functions.scalars import FUNCTIONS
from gridlens.plans.compile import aggregate, column, project, where
from gridlens.plans.lexer import FormulaError
from pyspark.sql import functions as F
from test_formulas import CASES

LAZY = {"IF", "IFERROR", "AND", "OR", "CHOOSE", "TODAY", "ROW", "COLUMN"}
#: Constants whose type or failure shows only inside a workbook.
NOT_HERE = ("{", "ROW", "COLUMN", "TODAY", "#REF!)", "AND()", "=5e22", "0.0000003")


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize(("formula", "want"), [c for c in CASES if c[1] is not None and not any(x in c[0] for x in NOT_HERE)])
def test_scalars_agree_with_the_evaluator(one, formula, want):
    from gridlens.plans.compile import compiled

    v = compiled(one, formula)
    got = one.select(coerce.text(v).alias("x")).first().x
    assert got.upper() == want if want in ("TRUE", "FALSE") else got == want


def test_every_function_has_both_forms():
    both = set(SCALARS) | set(AGGREGATES)
    lookups = {"MATCH", "INDEX", "VLOOKUP", "HLOOKUP", "XLOOKUP"}
    assert len(set(FUNCTIONS) | LAZY) == 62
    assert (set(FUNCTIONS) | LAZY) - both == lookups | {"ROW", "COLUMN"}


def test_numbers_as_text(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1e7, 1.5e7, 123456789.25, 1e20, 1e21, 1.5e300, 0.1, 0.001, 0.00012, 1e-6, 1e-7, 2.5e-10, float("nan"), float("inf"), float("-inf")]
    from gridlens.functions.scalars import num_text

    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(coerce.num_to_text(F.col("v")).alias("x")).collect()]
    assert got == [num_text(v) for v in values]


def test_cells_are_typed_at_run_time(spark):
    df = spark.createDataFrame([("5",), ("1,000",), ("TRUE",), ("abc",), ("",), (None,), (" 7 ",), ("0x1F",), ("1d",)], "v string")
    rows = project(df, n="=[v]+0", big="=[v]>4", num="=ISNUMBER([v])", txt="=ISTEXT([v])", blank="=ISBLANK([v])", five='=[v]=5', shown='=[v]&"!"').collect()
    assert [r.n for r in rows] == [5, 1000, 1, 0, 0, 0, 7, 31, 0]
    assert [r.num for r in rows] == [True, True, False, False, False, False, True, True, False]
    assert [r.txt for r in rows] == [False, False, False, True, True, True, False, False, True]
    assert [r.blank for r in rows] == [False] * 4 + [True, True] + [False] * 3
    assert [r.shown for r in rows] == ["5!", "1000!", "true!", "abc!", "!", "!", "7!", "31!", "1d!"]
    assert [r.five for r in rows] == [True] + [False] * 8


def test_criteria(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("", "a"), ("x", None)], "v string, k string")
    got = aggregate(df, [], low='=COUNTIF([v],"<2")', zero='=COUNTIF([v],"=")', is_a='=COUNTIF([k],"a")', not_a='=COUNTIF([k],"<>a")', total='=SUMIFS([v],[k],"a")', mean='=AVERAGEIFS([v],[k],"zz")', both='=COUNTIFS([v],">0",[k],"b")').first()
    assert (got.low, got.zero, got.is_a, got.not_a, got.total, got.mean, got.both) == (3, 2, 2, 2, 1, "#DIV/0!", 1)


def test_empty_aggregates(spark):
    df = spark.createDataFrame([], "v double")
    got = aggregate(df, [], s="=SUM([v])", a="=AVERAGE([v])", c="=COUNT([v])", m="=SUBTOTAL(4,[v])", x="=MAX([v])").first()
    assert (got.s, got.a, got.c, got.m, got.x) == (0, "#DIV/0!", 0, float("-inf"), 0)


def test_filters_reach_the_scan(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = where(t, "=[l_quantity]>45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "Python" not in plan


def test_errors(spark):
    df = spark.range(1)
    for bad, kind in (("=[nope]+1", FormulaError), ("=A1+1", FormulaError), ("=LEFT()", FormulaError), ("=VLOOKUP(1,2,3)", Unsupported), ('=SUBTOTAL(3,[id])', Unsupported), ("=COUNTIF([id],[id])", Unsupported)):
        with pytest.raises(kind):
            column(df, bad)


def test_sql_functions(spark):
    register_sql(spark)
    r = spark.sql("select xl_round(-2.5D, 0) a, xl_roundup(2.611D, 1) b, xl_rounddown(-2.69D, 1) c, xl_edate(xl_serial(date'2023-01-31'), 1) d, xl_date(45368) e, xl_is_error('#N/A') f, xl_is_error('#CALC!') g, xl_left('abc', -1) h").first()
    assert (r.a, r.b, r.c, r.d, str(r.e), r.f, r.g, r.h) == (-2, 2.7, -2.6, 44988, "2024-03-17", True, False, "")


FORMATS = [
    ("45368", "yyyy/m/d", "2024/3/17"), ("45368", "m月d日", "3月17日"), ("45368", "yyyy/mm/dd", "2024/3/17"), ("45368", "yyyy-mm-dd", "2024-03-17"), ("0.5", "hh:mm:ss", "12:00:00"), ("45368.25", "m/d/yy h:mm", "2024-03-17 06:00:00"),
    ("45368", "[$-411]ggge年m月d日", "令和6年3月17日"), ("40000", "ggge年m月d日", "平成21年7月6日"), ("13", "yyyy/m/d", "1900/1/12"), ("0.256", "0.0%", "25.6%"), ("1234.5", "#,##0.00", "1,234.50"), ("1234.5", "0", "1235"), ("-1234", "#,##0", "-1,234"),
    ("0", '#,##0;-#,##0;"-"', "-"), ("0", '_ ¥* #,##0_ ;_ ¥* -#,##0_ ;_ ¥* "-"_ ;_ @_ ', "¥ -"), ("1234", "0.00E+00", "1.23E+03"), ("0.5", "# ?/?", "1/2"), ("0.3333333333", "# ?/?", "1/3"), ("abc", "0.00", None), ("5", "General", None), ("", "0", None), ("1200", '"¥"#,##0', "¥1,200"), ("-5", '"¥"#,##0', "-¥5"),
    ("3", '#,##0"days"', "1900-01-02 00:00:00"), ("45368.5", "m-", "2024-03-17"), ("45368", "x m/", "2024-03-17"), ("0.75", "mm:ss", "18:00:00"), ("0", '0;0;"a-b"', "0"), ("0", "0;0;$?-", "$ -"), ("1.005", "0.00", "1.01"),
    ("2.5", "0\\.0", "2.5"), ("12", "\\;0", None), ("1234567", "[Red]#,##0_);[Blue]0", "1,234,567"), ("0.00012345", "0.0E+000", "1.2E-004"), ("7", "[0", "7"), ("7", '"0', "7"),
]


@pytest.mark.parametrize(("raw", "code", "want"), FORMATS)
def test_number_formats(one, raw, code, want):
    literal, column = formats.display(F.lit(raw), code), formats.display(F.lit(raw), F.lit(code), F.lit(0))
    assert tuple(one.select(literal.alias("x"), column.alias("y")).first()) == (want, want)


def test_formats_by_id(one):
    show = lambda raw, i: one.select(formats.display(F.lit(raw), F.lit("General"), F.lit(i)).alias("x")).first().x
    assert show("123", 186) == "1 2 3" and show("1234", 42) == "¥ 1,234"
    assert one.select(formats.builtin_code(F.lit(14)).alias("x")).first().x == "yyyy/m/d"


def test_markdown_text(one):
    run = lambda f, t: one.select(f(F.lit(t)).alias("x")).first().x
    assert run(markdown.escape, "# a\n- b\n1. c\n* d <x> & `y` |z| \\") == "\\# a\n\\- b\n1\\. c\n\\* d &lt;x&gt; &amp; \\`y\\` \\|z\\| \\\\"
    assert run(markdown.escape, "a # b - c 1. d") == "a # b - c 1. d"
    assert run(markdown.escape_line_start, "  > q") == "  \\> q"
    assert run(markdown.normalize, "a\r\nb\tc\x07d​e") == "a b c d e"
    assert run(markdown.table_cell, "a|b") == "a\\|b" and run(markdown.heading, "## x") == "x" and run(markdown.list_item, "- x") == "x" and run(markdown.list_item, "12. x") == "x"
    assert run(markdown.compact, "  a \n\n b* ") == "a b\\*"
    assert run(markdown.fragment, " My <b>Sheet</b>! 東京_1 ") == "my-sheet-東京_1"


def test_rich_text(spark):
    run = "struct<text:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean>"
    df = spark.createDataFrame([
        ("ab c", [("a", True, False, False, False), ("b ", True, False, False, False), ("c", False, True, True, True)], (False, False, False, False)),
        ("x\ny", None, (False, False, False, True)), ("other", [("text", True, False, False, False)], (False, False, False, False)), ("p", [("p", False, False, False, False)], (False, False, False, False)),
    ], f"t string, runs array<{run}>, s struct<bold:boolean,italic:boolean,strike:boolean,underline:boolean>")
    df = df.withColumn("merged", markdown.merge_runs(F.col("runs"), F.col("s")))
    rows = df.select(markdown.github_text(F.col("t"), F.col("s"), F.col("merged")).alias("x"), F.size("merged").alias("n"), "merged").collect()
    assert [r.x for r in rows] == ["**ab ***~~<ins>c</ins>~~*".replace("***", "***"), "<ins>x</ins><br><ins>y</ins>", "other", "p"]
    assert rows[0].n == 2 and rows[1].merged is None and rows[3].merged is None


def test_links(spark):
    df = spark.createDataFrame([("#'It''s'!B2", True), ("Data!A1", False), ("C3", True), ("", True)], "loc string, known boolean")
    sheet, ref = markdown.internal_target(F.col("loc"), F.lit("Here"))
    got = [r.x for r in df.select(markdown.internal_link(F.lit("L"), sheet, ref, F.col("known")).alias("x")).collect()]
    assert got == ["[L](#its) (It's!B2)", "L (Data!A1)", "[L](#here) (Here!C3)", "[L](#here)"]


def test_tables(one):
    rows = lambda x: F.array(*[F.array(*map(F.lit, r)) for r in x])
    run = lambda x, h=True: one.select(markdown.table(rows(x), h).alias("x")).first().x
    assert run([["a", "b"], ["1", "x|y"]]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    assert run([["a", "b"]]) == "| a | b |\n| --- | --- |\n|  |  |"
    assert run([["a"]], False) == "|  |\n| --- |\n| a |"


def test_addresses(spark):
    df = spark.createDataFrame([("$AB$12",), ("xfd1",), ("12A",), ("",)], "a string")
    row, col = address.split_address(F.col("a"))
    assert [(r.r, r.c) for r in df.select(row.alias("r"), col.alias("c")).collect()] == [address.cell(x) for x in ("$AB$12", "xfd1", "12A", "")] == [(12, 28), (1, 16384), (0, 0), (0, 0)]
    n = spark.range(1, 18_279)
    assert n.where(address.number_of(address.letters_of(F.col("id"))) != F.col("id")).count() == 0
    assert [address.letters(i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert address.rectangle("C3:A1") == (1, 1, 3, 3) and address.rectangle("x") is None and address.shown(1, 1, 3, 3) == "A1-C3"

import datetime as dt

import pytest
from gridlens.functions import scalars
from gridlens.plans.evaluate import Book, Evaluator, ListObject, key, solved
from gridlens.plans.lexer import FormulaError, tokens
from gridlens.plans.parser import Array, Binary, Call, Cell, Literal, Name, Postfix, Range, Structured, Unary, function_names, parse
from gridlens.sources.formulas import moved


def book(rows, formulas=None, sheet="S", **more):
    values = {(sheet, r, c): v for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None}
    at = {(sheet, *k): f for k, f in (formulas or {}).items()}
    return Book(values, at, {sheet, *more.pop("sheets", [])}, today=dt.date(2021, 2, 28), **more)


LOOKUP = [["oak", "12", "x"], ["elm", "24", "y"], ["ash", "36", "z"], ["elm", "48", "w"]]

CASES = [
    ('=IF(7>=7,"yes","no")', "yes"), ('=IF("",9,4)', "4"), ("=IF(3)", "TRUE"), ("=IF(0,8)", "FALSE"), ('=IFERROR(#NUM!,"none")', "none"), ('=IFERROR(6,"none")', "6"), ("=IFERROR(#NULL!)", ""),
    ('=AND(2,"x",5<6)', "TRUE"), ("=AND(0,TRUE)", "FALSE"), ("=AND()", "TRUE"), ('=OR(0,4>9,"")', "FALSE"), ("=OR(0,1)", "TRUE"), ("=NOT(8)", "FALSE"), ("=(20-5)%", "0.15"), ('=CHOOSE(1,"p","q","r")', "p"), ('=CHOOSE(5,"p","q")', None),
    ("=DATE(2021,2,28)", "44255"), ("=DATE(2021,14,3)", "44595"), ('=VALUE("98,765.25")', "98765.25"), ('=VALUE("2021-2-28")', "44255"), ('=VALUE(" ")', "0"), ('=VALUE("seven")', None), ('=DATEVALUE("2022年2月3日")', "44595"),
    ('=SUBSTITUTE("moon noon","oo","u")', "mun nun"), ('=SUBSTITUTE("moon noon","oo","u",2)', "moon nun"), ('=SUBSTITUTE("keep","","zz")', "keep"), ("=SUM({5,6,7})", "18"), ("={4;5}", None),
    ("=EOMONTH(DATE(2021,2,3),0)", "44255"), ("=EOMONTH(DATE(2021,1,9),-2)", "44165"), ("=EDATE(DATE(2021,2,28),12)", "44620"), ("=EDATE(DATE(2021,8,31),1)", "44470"),
    ("=ROUND(7.125,2)", "7.13"), ("=ROUND(-7.5,0)", "-7"), ("=ROUNDUP(4.021,2)", "4.03"), ("=ROUNDDOWN(4.029,2)", "4.02"), ("=ROUNDUP(-6.3,0)", "-7"), ("=INT(8.75)", "8"), ("=INT(-8.25)", "-9"), ("=ABS(-0.75)", "0.75"),
    ("=ROW(B$7)", "7"), ("=COLUMN(D$9)", "4"), ("=COLUMN(AA1:AC2)", "27"), ('=ISBLANK("q")', "FALSE"), ('=ISTEXT("77a")', "TRUE"), ("=ISTEXT(77)", "FALSE"), ("=ISERROR(#DIV/0!)", "TRUE"), ('=ISERROR("fine")', "FALSE"),
    ("=ISNA(NA())", "TRUE"), ("=ISNA(#REF!)", "FALSE"), ("=ISNUMBER(-4.5)", "TRUE"), ('=ISNUMBER("word")', "FALSE"), ('=ISNUMBER("3,300")', "TRUE"), ("=NA()", "#N/A"),
    ('=LEFT("hedgehog",5)', "hedge"), ('=LEFT("hedgehog")', "h"), ('=RIGHT("hedgehog",3)', "hog"), ('=RIGHT("hedgehog",0)', ""), ('=MID("hedgehog",3,4)', "dgeh"), ('=TRIM("   one   two ")', "one two"), ('=REPLACE("hedgehog",1,5,"ground")', "groundhog"),
    ('=LOWER("MiXed 1")', "mixed 1"), ('=UPPER("MiXed 1")', "MIXED 1"), ('=FIND("ge","hedgehog")', "4"), ('=FIND("GE","hedgehog")', "#VALUE!"), ('=SEARCH("GE","hedgehog")', "4"), ('=FIND("h","hedgehog",2)', "6"), ('=LEN("hedgehog 9")', "10"), ('=LEN("🦔")', "2"),
    ('=CONCATENATE("x",7,"y")', "x7y"), ('=7&"="&FALSE', "7=false"), ('=REPT("-",3)', "---"), ('=REPT("no",0)', ""), ("=TODAY()", "44255"), ("=YEAR(DATE(2021,2,28))", "2021"), ("=MONTH(DATE(2021,2,28))", "2"), ("=DAY(DATE(2021,2,28))", "28"),
    ("=WEEKDAY(DATE(2021,3,3))", "4"), ("=WEEKDAY(DATE(2021,3,3),2)", "3"), ("=WEEKDAY(DATE(2021,3,3),3)", "2"), ('=TEXT(9876.5,"#,##0.00")', "9,876.50"), ('=TEXT(42,"0000")', "0042"), ('=TEXT(3.14159,"0.0")', "3.1"), ('=TEXT(-5.5,"#,##0")', "-6"),
    ('=TEXT(44258,"yyyy/mm/dd")', "2021/3/3"), ('=TEXT(44258,"yyyy-mm-dd")', "2021-03-03"), ('=TEXT(0.25,"hh:mm:ss")', "06:00:00"), ("=5/0", "Infinity"), ("=-5/0", "-Infinity"), ("=0/0", "NaN"), ("=#REF!+4", "4"),
    ('="true"+3', "4"), ('="0b101"+0', "5"), ('="0o17"+1', "16"), ('="12kg"+1', "1"), ('=5="5"', "TRUE"), ('="Kg"="kg"', "FALSE"), ('="pear"<"plum"', "TRUE"), ('="8">"70"', "TRUE"), ('="30"<4', "FALSE"),
    ("=10-4-3", "3"), ("=-50%", "-0.5"), ("=2+3*4", "14"), ("=(2+3)*4", "20"), ("=3^2", None), ("=MISSING(1)", None), ("=5e22", "5e+22"), ("=0.0000003", "3e-7"), ("=25000000", "25000000"), ("=0.7+0.1", "0.7999999999999999"),
]


@pytest.mark.parametrize(("formula", "want"), CASES)
def test_constants(formula, want):
    assert Evaluator(book([])).formula("S", formula) == want


RANGES = [
    ('=VLOOKUP("elm",A1:C4,2,FALSE)', "24"), ('=VLOOKUP("fir",A1:C4,2,FALSE)', "#N/A"), ("=VLOOKUP(30,B1:C4,2,TRUE)", "y"), ("=VLOOKUP(5,B1:C4,2)", "#N/A"), ('=XLOOKUP("elm",A1:A4,B1:B4,"NF")', "24"), ('=XLOOKUP("elm",A1:A4,B1:B4,"NF",0,-1)', "48"),
    ('=XLOOKUP(30,B1:B3,C1:C3,"NF",-1)', "y"), ('=XLOOKUP(30,B1:B3,C1:C3,"NF",1)', "z"), ('=XLOOKUP("o*",A1:A3,C1:C3,"NF",2)', "x"), ('=XLOOKUP("z*",A1:A3,C1:C3,"NF",2)', "NF"), ('=XLOOKUP(24,B1:B3,C1:C3,"NF",0,2)', "y"),
    ('=XLOOKUP(30,B1:B3,C1:C3,"NF",-1,2)', "y"), ('=XLOOKUP(5,B1:B3,C1:C3,"NF",-1,2)', "NF"), ('=MATCH("elm",A1:A4,0)', "2"), ('=MATCH("fir",A1:A4,0)', "#N/A"), ("=INDEX(A1:C4,2,3)", "y"), ("=INDEX(A1:C4,9,9)", None),
    ("=SUM(B1:B3,5)", "77"), ("=MAX(B1:B3,5)", "36"), ("=MIN(B1:B3,5)", "5"), ("=AVERAGE(B1:B3,8)", "20"), ("=COUNT(A1:B3,10)", "4"), ("=COUNTA(A1:B5,10)", "9"), ("=SUBTOTAL(9,B1:B3)", "72"), ("=SUBTOTAL(101,B1:B3)", "24"), ("=SUBTOTAL(4,D1:D1)", "0"), ("=SUBTOTAL(3,B1:B3)", None),
    ("=SUMPRODUCT(B1:B3,{1;2;3})", "168"), ("=SUMPRODUCT(B1:B3,{1,2})", None), ('=COUNTIF(B1:B5,"<5")', "1"), ('=COUNTIF(A1:A4,"elm")', "2"), ('=COUNTIF(A1:A4,"<>elm")', "2"), ('=SUMIF(A1:A4,"elm",B1:B4)', "72"), ('=SUMIFS(B1:B4,A1:A4,"elm",B1:B4,">24")', "48"),
    ('=COUNTIFS(A1:A4,"elm",B1:B4,">24")', "1"), ('=AVERAGEIF(A1:A4,"elm",B1:B4)', "36"), ('=AVERAGEIF(A1:A4,"fir",B1:B4)', "#DIV/0!"), ('=AVERAGEIFS(B1:B4,A1:A4,"elm")', "36"), ("=SUM(A1:C3 B2:D4)", "60"), ("=A1:A2 B1:B2", "#NULL!"), ("=B1", "12"), ("=Z99", ""), ("=Nope!A1", "#REF!"),
    ('=HLOOKUP("oak",A1:C4,2,FALSE)', "elm"), ("=SUM(A1:INDEX(B1:B4,2))", "36"),
]


@pytest.mark.parametrize(("formula", "want"), RANGES)
def test_ranges(formula, want):
    assert Evaluator(book(LOOKUP)).formula("S", formula) == want


def test_descending_binary_search():
    keys = [30.0, 20.0, 10.0]
    assert [scalars.xlookup(25.0, keys, list("CBA"), "NF", m, -2) for m in (1, -1)] == ["C", "B"]
    assert scalars.xlookup(35.0, keys, list("CBA"), "NF", 1, -2) == "NF"


def test_names_tables_spills_and_cycles():
    b = book(LOOKUP, {(9, 1): "=A9+1", (9, 2): "=B10", (10, 2): "=B9", (9, 3): "=SUM(C10:C11)", (10, 3): "=1+1", (11, 3): "=C10*2", (9, 4): "=SUM(D10#)"}, sheets=["Other"])
    b.names = {("", key("Base")): "=S!B2", ("S", key("base2")): "=B3", ("", key("Base2")): "=1", ("", key("Rng")): "=S!$B$1:$B$3"}
    b.tables = {key("T"): ListObject("S", "A1", "B4", ["Name", "Qty"], 1, 0)}
    run = Evaluator(b)
    assert run.value("S", 9, 1) == "1" and run.value("S", 9, 2) == ""  # cycles read as blank
    assert run.value("S", 9, 3) == "6" and run.value("S", 9, 4) == "0"
    assert [run.formula("S", f) for f in ("=Base", "=Base2", "=SUM(Rng)", "=SUM(T[Qty])", "=T[[#All],[Qty]]", "=SUM(ｔ[qty])", "=Other!Base2")] == ["24", "36", "72", "108", None, "108", "1"]
    assert run.formula("S", "=ROW()", 12, 3) == "12" and run.formula("S", "=COLUMN()", 12, 3) == "3"


@pytest.mark.parametrize("n", [10, 1000, 20_000])
def test_long_chains(n):
    """Each cell reads the one below; and a running total down a column."""
    b = book([], {(r, 1): f"=A{r + 1}+1" for r in range(1, n)} | {(r, 2): f"=B{r - 1}+{r}" for r in range(2, n + 1)} | {(n, 1): "=1", (1, 2): "=1"})
    run = Evaluator(b)
    assert run.value("S", 1, 1) == str(n) and run.value("S", n, 2) == str(n * (n + 1) // 2)


def test_long_sums_and_wide_ranges():
    n = 3000
    b = book([], {(r, 1): f"={r}" for r in range(1, n + 1)} | {(1, 2): f"=SUM(A1:A{n})", (2, 2): "=" + "+".join(f"A{r}" for r in range(1, n + 1))})
    run = Evaluator(b)
    assert run.value("S", 1, 2) == run.value("S", 2, 2) == str(n * (n + 1) // 2)
    assert function_names("=" + "+".join(["ABS(1)"] * 2000)) == ["ABS"] * 2000


def test_branches_not_taken_are_not_evaluated():
    b = book([["1"]], {(1, 2): "=IF(A1>0,5,C1)", (1, 3): "=B1+1"})
    assert [solved(b, [("S", 1, 2), ("S", 1, 3)])[at] for at in (("S", 1, 2), ("S", 1, 3))] == ["5", "6"]


def test_cycles_have_one_result():
    two = {("S", 1, 1): "=A2+1", ("S", 2, 1): "=A1+1"}
    for order in (list(two), list(two)[::-1]):
        first, second = order
        got = solved(Book(formulas={at: two[at] for at in order}, sheets={"S"}), order)
        assert (got[first], got[second]) == ("3", "2")
    assert solved(Book(formulas={("S", 1, 1): "=A1+1"}, sheets={"S"}), [("S", 1, 1)]) == {("S", 1, 1): "2"}


def test_trees():
    assert parse("=A1+B2*3") == Binary("+", Cell("A1"), Binary("*", Cell("B2"), Literal(3.0)))
    assert parse("(A1+B1)%") == Postfix("%", Binary("+", Cell("A1"), Cell("B1")))
    assert parse("=A1#") == Postfix("#", Cell("A1"))
    assert parse("={1,2;3,4}") == Array(((Literal(1.0), Literal(2.0)), (Literal(3.0), Literal(4.0))))
    assert parse("=A1:C3 B2:D4") == Binary(" ", Range(Cell("A1"), Cell("C3")), Range(Cell("B2"), Cell("D4")))
    assert parse("='My Sheet'!A1") == Cell("A1", "My Sheet") and parse("=S!Name") == Name("Name", "S")
    assert parse("=T[[#Totals],[a b]]") == Structured("T", "a b", "#Totals")
    assert parse("=-A1&\"x\"") == Binary("&", Unary("-", Cell("A1")), Literal("x"))
    assert parse("=sum(1)") == Call("SUM", (Literal(1.0),))
    deep = "(" * 200 + "1" + ")" * 200
    for bad in ("=" + deep, "=" + "-" * 200 + "1", "=1+", "=(1", "=2^3", "=\"open", "=1 2", "=}"):
        with pytest.raises(FormulaError):
            parse(bad)
    assert function_names("=SUM(IF(A1,1,2))") == ["SUM", "IF"] and function_names("=(") == []
    assert [t.value for t in tokens('="a""b"&#REF!')] == ['a"b', "&", "#REF!"]


def test_moved_formulas():
    assert moved("=A1+$B$2*C$3", 2, 1) == "=B3+$B$2*D$3"
    assert moved("='My Sheet'!A1+Sheet2!$A1", 1, 1) == "='My Sheet'!B2+Sheet2!$A2"
    assert moved("=B2", -5, -5) == "=A1"


def test_intersection_query_evaluates_a_formula(spark, sf_dir, monkeypatch):
    from gridlens import catalog
    from gridlens.plans import evaluate

    seen, resolve = [], evaluate.resolve
    monkeypatch.setattr(evaluate, "resolve", lambda cells, *rest: seen.append(cells) or resolve(cells, *rest))
    got = {r.l_orderkey: r.both for r in catalog.op_intersection(spark, sf_dir).collect()}
    assert seen and all(" " in r.formula for r in seen[0].where("pending").collect())
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        want[r.l_orderkey] = want.get(r.l_orderkey, 0) + (float(r.l_quantity) if r.l_linenumber in (4, 5) else 0)
    assert got == {k: round(v, 2) for k, v in want.items()}

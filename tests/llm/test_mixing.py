import duckdb
import pytest
from gridlens.llm import mixing, queries

WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "*": 2}, "source": {"*": 1}}


def share(budget, children):
    """Water-filling by hand: (name, weight, room) -> budgets, what one cannot use going to the others."""
    out, left, open_ = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], str(c[0])))
    while open_:
        total = sum(w for _, w, _ in open_)
        name, w, room = open_[0]
        if room * total <= left * w:
            out[name] = room
            left -= room
            open_.pop(0)
        else:
            return out | {n: left * w // total for n, w, _ in open_}
    return out


def brute(rows, weights, total, epochs):
    """Budgets by leaf."""
    tree = {}
    for d, lang, s, t in rows:
        tree.setdefault(d, {}).setdefault(lang, {}).setdefault(s, 0)
        tree[d][lang][s] += t
    w = lambda level, v: weights[level].get(v, weights[level].get("*", 1))
    size = lambda x: epochs * x if isinstance(x, int) else sum(map(size, x.values()))
    out = {}
    top = share(min(total, size(tree)), [(d, w("domain", d), size(x)) for d, x in tree.items()])
    for d, b in top.items():
        for lang, c in share(b, [(v, w("lang", v), size(x)) for v, x in tree[d].items()]).items():
            for s, e in share(c, [(v, w("source", v), size(x)) for v, x in tree[d][lang].items()]).items():
                out[d, lang, s] = e
    return out


LEAVES = [("web", "en", "src0", 900), ("web", "en", "src1", 50), ("web", "de", "src2", 300), ("books", "en", "src4", 20), ("books", None, "src5", 10), ("forum", "fr", "src7", 5000), ("forum", "fr", None, 1), ("forum", "en", "src8", 0)]


@pytest.mark.parametrize("total", [0, 7, 100, 999, 2500, 5000, 100_000])
def test_budgets(spark, total):
    df = spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, WEIGHTS, total, 2).collect()}
    want = brute(LEAVES, WEIGHTS, total, 2)
    assert got == {(d, lang, s): want[d, lang, s] for d, lang, s, _ in LEAVES}
    assert sum(got.values()) <= total


@pytest.mark.parametrize("share_", [0.3, 1.0, 3.0])
@pytest.mark.parametrize("per_bucket", [3, 50_000])
def test_prefixes_of_epochs(odd_docs, odd_rows, share_, per_bucket):
    out = mixing.mixed(odd_docs, WEIGHTS, share=share_, per_bucket=per_bucket).collect()
    used = {}
    for r in out:
        used.setdefault((r.domain, r.lang, r.source), []).append((r.epoch, r.id, r.tokens))
    df = odd_docs.select(mixing.domain_of(odd_docs.source).alias("domain"), "lang", "source", mixing.tokens_of(odd_docs.text).alias("tokens"))
    leaves = df.groupBy("domain", "lang", "source").sum("tokens").toDF("domain", "lang", "source", "tokens")
    total = int(sum(r.tokens for r in leaves.collect()) * share_)
    for r in mixing.budgets(leaves, WEIGHTS, total, 2).collect():
        mine = used.get((r.domain, r.lang, r.source), [])
        assert sum(t for *_, t in mine) <= r.budget
        whole = r.budget // r.tokens if r.tokens else 0
        for e in range(whole):
            assert sum(t for x, _, t in mine if x == e) == r.tokens


def test_oracle_on_odd_rows(odd_docs, odd_rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", odd_rows)
    want = sorted(con.execute(queries._mixing_sql()).fetchall(), key=str)
    got = mixing.mixed(odd_docs, queries.WEIGHTS, seed=queries.SEED).selectExpr("id as doc_id", "domain", "lang", "source", "tokens", "epoch").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_columns_and_empty_table(clashing_docs, no_docs):
    out = mixing.mixed(clashing_docs, WEIGHTS).select("row.*")
    assert out.columns == clashing_docs.columns and out.count() > 0
    assert mixing.mixed(no_docs, WEIGHTS).count() == 0


def test_plan_is_native(odd_docs):
    plan = mixing.mixed(odd_docs, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

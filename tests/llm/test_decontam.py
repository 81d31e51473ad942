import random

import numpy as np
import pytest
from gridlens.llm import decontam


def local_score(doc, item):
    """Smith-Waterman, cell by cell."""
    best, now = 0, [[0] * (len(item) + 1) for _ in range(len(doc) + 1)]
    for i, a in enumerate(doc, 1):
        for j, b in enumerate(item, 1):
            now[i][j] = max(0, now[i - 1][j - 1] + (2 if a == b else -1), now[i - 1][j] - 1, now[i][j - 1] - 1)
            best = max(best, now[i][j])
    return best


def vocabulary(rng, n):
    return [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randint(0, 99)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    v = vocabulary(rng, 400)
    text = lambda n: [rng.choice(v) if rng.random() < 0.7 else "the" for _ in range(n)]
    items = [(i, text(rng.randint(12, 40))) for i in range(15)]
    docs = []
    for i in range(120):
        w = text(rng.randint(0, 150))
        if i % 4 == 0:
            passage = list(items[rng.randrange(15)][1])
            for _ in range(rng.randint(0, len(passage) // 5)):  # edits
                k = rng.randrange(len(passage))
                op = rng.randint(0, 2)
                passage[k : k + 1] = [] if op == 0 else ["edited"] if op == 1 else [passage[k], "inserted"]
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (None, " ".join(items[0][1])), (502, " ".join(items[1][1]).upper().replace(" ", ", ")), (503, " ".join(text(20_000)) + " " + " ".join(items[2][1])), (504, " ".join(items[3][1]))] + [(504, " ".join(items[3][1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "two words"), (93, "the the"), (94, "the"), (None, " ".join(text(20))), (0, " ".join(items[0][1]))]
    return docs, bench, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def wanted(docs, bench, least=0.5):
    out = []
    for d, t in docs:
        words = decontam.words(t)
        if len(words) > 3000:
            words = words[-200:]
        for i, item in bench:
            want = decontam.words(item)
            if len(want) >= 3 and local_score(words, want) / (2 * len(want)) >= least:
                out.append((d, i))
            elif 0 < len(want) < 3 and any(words[k : k + len(want)] == want for k in range(len(words))):
                out.append((d, i))
    return sorted(out, key=str)


def test_finds_what_brute_force_finds(tables):
    docs, bench, d, b = tables
    want = wanted(docs, bench)
    assert len(want) > 25
    for size in (decontam.BLOCK, 400):
        got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(d, b, block_bytes=size).collect()), key=str)
        assert got == want


def test_places_and_scores(tables):
    docs, bench, d, b = tables
    for r in decontam.contaminated(d, b).where("(doc_id = 504 or doc_id = 502) and item_id < 90").collect():
        assert r.score == 1.0 and (r.first_word, r.end_word) == (0, len(decontam.words(dict((i, t) for i, t in bench if i)[r.item_id])))


def test_decontaminate_keeps_clean_rows_whole(tables):
    from pyspark.sql import functions as F

    docs, bench, d, b = tables
    wide = d.withColumns({c: F.lit("x") for c in ("leaks", "leaks_0", "row", "text_again", "item_id")})
    bad = {x for x, _ in wanted(docs, bench)}
    kept = decontam.decontaminate(wide, b)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, _ in docs if x not in bad)


def test_empty_tables(tables):
    _, _, d, b = tables
    assert decontam.contaminated(d.limit(0), b).count() == 0
    assert decontam.contaminated(d, b.limit(0)).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).count() == d.count()


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        doc, item = ([rng.randint(1, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontam.align(np.array(doc), np.array(item))[0] == local_score(doc, item)


def edited(rng, item, share, kinds):
    """A copy with about that share of its words changed, left out, or with words put in behind them."""
    out = []
    for w in item:
        kind = rng.choice(kinds) if rng.random() < share else "keep"
        out += {"keep": [w], "change": [f"c{rng.getrandbits(30)}"], "drop": [], "insert": [w, *[f"i{rng.getrandbits(30)}" for _ in range(rng.randint(1, 3))]]}[kind]
    return out


def test_no_alignment_is_cut():
    """Thousands of edited copies, as they stand in a text or alone: found with the score that all cells give, wherever three
    successive words are left."""
    rng = random.Random(8)
    n = missed = 0
    for _ in range(5000):
        item = vocabulary(rng, rng.randint(5, 24))
        copy = edited(rng, item, rng.uniform(0, 0.6), rng.choice([("insert",), ("change", "drop"), ("insert", "change", "drop")]))
        text = vocabulary(rng, rng.randint(0, 10)) + copy + vocabulary(rng, rng.randint(0, 10))
        want = local_score(text, item) / (2 * len(item))
        block = decontam.Block([(1, " ".join(item))])
        got = decontam.leaks_of(block, block.read(" ".join(text)), 0.5)
        if want >= 0.5:
            n += 1
            runs = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
            if not runs & {tuple(text[k : k + 3]) for k in range(len(text))}:
                missed += 1
                assert not got
                continue
        assert [round(s, 9) for _, s, *_ in got] == ([round(want, 9)] if want >= 0.5 else [])
    assert n > 2000 and missed / n < 0.03


@pytest.mark.parametrize("size", [20, 24, 30, 40, 60])
def test_words_put_in_all_over(size):
    """A word behind every second one: the alignment is half as long again as the item."""
    item = [f"w{i}" for i in range(size)]
    text = [x for i, w in enumerate(item) for x in ([w] if i < 4 or i % 2 else [w, f"x{i}"])]
    want = local_score(text, item) / (2 * size)
    block = decontam.Block([(1, " ".join(item))])
    ((_, score, first, end),) = decontam.leaks_of(block, block.read(" ".join(text)), 0.45)
    assert score == want >= 0.5 and (first, end) == (0, len(text))


def test_edited_copies_of_an_item_with_many_copies(spark):
    rng = random.Random(6)
    item = vocabulary(rng, 38)
    edited = [[f"other{i}" if i % step == step - 1 else w for i, w in enumerate(item)] for step in (5, 6, 7)]
    # exact copies with one edited copy of each kind; and a kind that itself has many copies
    for texts in ([item] * 40 + edited, [item] * 10 + [edited[0]] * 30):
        docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
        found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        assert sorted(r.doc_id for r in found.collect()) == list(range(len(docs)))

import random

import brute
import numpy as np
import pytest
from gridlens.llm import simhash


def near_texts(rng, n=40):
    out = []
    for g in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            out.append(" ".join(w))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] or 0)


@pytest.mark.parametrize("cap", [simhash.CAP, 2])
@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_classes_equal_brute_force(spark, odd_rows, cap, most):
    rows = [r[:2] for r in odd_rows] + [(1000 + i, t) for i, t in enumerate(near_texts(random.Random(1)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.hamming_classes(docs, 3, most, cap).collect()]
    assert sorted(got, key=key) == sorted(brute.hamming_classes(rows, 3, most), key=key)


def test_fingerprints_of_few_words():
    for t in (None, "", " \n", "One", "one TWO", "one two three", "É a b\x0bc\x1cd"):
        assert simhash.fingerprint(simhash.shingles(t, 3)) == brute.simhash(t, 3)


def test_crowded_buckets_link_the_same(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(600)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "node long")
    from gridlens.llm.common import Scratch, connected_components

    arr = np.array(prints, np.uint64)
    links = [(i, j) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2).tolist() if j > i]
    want = brute.components(list(range(len(arr))), links)
    for cap in (10, 10_000):
        scratch = Scratch(spark, "t")
        got = {r.node: r.component for r in connected_components(simhash._hamming_links(df, 2, scratch, cap), scratch).collect()}
        groups = {}
        for i, p in enumerate(signed):
            groups.setdefault(got.get(p, p), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_clashing_columns_and_empty_table(clashing_docs, odd_rows, no_docs):
    assert simhash.hamming_classes(clashing_docs).count() == len(odd_rows)
    assert simhash.hamming_classes(no_docs).count() == 0
    assert simhash.drop_similar(no_docs).count() == 0


def test_similar_documents_keep_one(spark):
    """At 0.8 itself, whatever the size of the buckets."""
    texts = near_texts(random.Random(2), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = brute.similar_pairs(list(enumerate(texts)), 5)
    want = brute.components(list(range(len(texts))), [(a, b) for a, b, j in pairs if j >= 0.8])
    assert any(0.8 <= j < 0.85 for *_, j in pairs) and any(0.75 < j < 0.8 for *_, j in pairs)
    for cap in (simhash.CROWD, 3):
        assert sorted(r.doc_id for r in simhash.drop_similar(docs, cap=cap).collect()) == [i for i in want if want[i] == i]


def test_sizes_at_the_ratio_meet_in_a_band(spark):
    """Sets within one another whose sizes are just in the ratio of the limit."""
    rng, texts = random.Random(4), []
    for n in (8, 12, 40, 100, 200, 400):
        words = [f"v{rng.getrandbits(40)}" for _ in range(n + 4)]
        texts += [" ".join(words), " ".join(words[: n * 4 // 5 + 4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.components(list(range(len(texts))), [(a, b) for a, b, j in brute.similar_pairs(list(enumerate(texts)), 5) if j >= 0.8])
    for cap in (simhash.CROWD, 1):
        assert sorted(r.doc_id for r in simhash.drop_similar(docs, cap=cap).collect()) == [i for i in want if want[i] == i]


def test_recall_by_similarity_on_the_test_table(spark, sf_dir):
    """All pairs of the table by brute force: every pair at 0.8 or more is in one class, none is joined that no chain of such
    pairs joins."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pairs = brute.similar_pairs(rows, 5)
    want = brute.components(list(range(len(rows))), [(a, b) for a, b, j in pairs if j >= 0.8])
    empty = [i for i, (_, t) in enumerate(rows) if not (t or "").split()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.similarity_classes(docs).collect()}
    label = [got[d] for d, _ in rows]
    assert all(label[a] == label[b] for a, b, j in pairs if j >= 0.8)
    assert len(set(label)) == len({want[i] for i in range(len(rows)) if i not in empty}) + bool(empty)


def test_drop_similar_keeps_columns_and_odd_rows(clashing_docs, odd_rows):
    out = simhash.drop_similar(clashing_docs)
    assert out.columns == clashing_docs.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(302) == 1 and 100 in ids and not {*range(101, 130), *range(200, 212)} & set(ids)
    # texts without words are one class: its least doc_id stays
    assert 300 in ids and 301 not in ids and 304 not in ids
    assert sum(r.text == "no id here" for r in rows) == 1 and {303, 305, 306, 307} <= set(ids)


def test_patterns_cover_every_viable_chain():
    from itertools import product

    allowed = simhash.budgets(simhash.CELLS, 7)
    wanted = [{0, 1, *t} for t in simhash._triples()]
    for differ in product((0, 1), repeat=8):
        if all(sum(differ[: i + 1]) <= allowed[i] for i in range(8)):
            equal = {i for i in range(8) if not differ[i]}
            assert any(w <= equal for w in wanted)


def edited_pair(rng, shingles, edits):
    """Two texts whose 5-word shingle sets have a similarity of (shingles - 5 edits) / (shingles + 5 edits)."""
    base = [f"w{rng.getrandbits(40)}" for _ in range(shingles + 4)]
    other = list(base)
    for k in range(edits):
        other[4 + k * (shingles - 4) // edits] = f"e{rng.getrandbits(40)}"
    return " ".join(base), " ".join(other)


def test_decisions_at_the_limit_are_exact(spark):
    rng = random.Random(11)
    texts = [t for k in range(60) for t in edited_pair(rng, 450 if k % 6 else 45, 9 + k % 3 if k % 6 else 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = brute.similar_pairs(list(enumerate(texts)), 5)
    assert {0.8} < {round(j, 3) for *_, j in pairs}
    want = brute.components(list(range(len(texts))), [(a, b) for a, b, j in pairs if j >= 0.8])
    for cap in (simhash.CROWD, 3):
        assert sorted(r.doc_id for r in simhash.drop_similar(docs, cap=cap).collect()) == [i for i in want if want[i] == i]


def test_crowded_buckets_find_the_same_pairs(spark):
    """Pairs with 8 segments or more that differ, which share a start: no chain of a crowded bucket holds them."""
    rng, texts = random.Random(12), []
    while len(texts) < 8:
        a, b = edited_pair(rng, 450, 9)
        equal = np.equal(*[simhash.ring(np.unique(simhash.shingles(t, 5))) for t in (a, b)])
        starts = [{i, *((i + s) % 16 for s in t)} for i in range(16) for t in [(0, 1, *x) for x in simhash._triples()]]
        if (equal & np.roll(equal, -1)).any() and not any(equal[list(s)].all() for s in starts):
            texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cap in (simhash.CROWD, 1):
        assert sorted(r.doc_id for r in simhash.drop_similar(docs, cap=cap).collect()) == [0, 2, 4, 6]

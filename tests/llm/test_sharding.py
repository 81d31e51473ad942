import zlib
from collections import defaultdict

import numpy as np
from brute import components  # noqa: F401
from gridlens.llm import sharding


def check(rows, docs, k):
    got = [tuple(r) for r in docs]
    assert sorted((d is None, d or 0, t or "") for d, t, *_ in rows) == sorted((r[0] is None, r[0] or 0, r[5]) for r in got)
    by_text, slots = defaultdict(set), defaultdict(list)
    for d, size, crc, shard, slot, text in got:
        by_text[text].add(shard)
        slots[shard].append(slot)
        assert crc == zlib.crc32(text.encode())
        assert 0 <= shard < k
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def collected(docs, rows, k, **options):
    text = {zlib.crc32((t or "").encode()): t or "" for _, t, *_ in rows}
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, text[r.text_crc32]) for r in sharding.balanced_shards(docs, k, **options).collect()]


def test_odd_rows(odd_docs, odd_rows):
    check(odd_rows, collected(odd_docs, odd_rows, 5), 5)


def test_many_levels(odd_docs, odd_rows):
    check(odd_rows, collected(odd_docs, odd_rows, 3, bucket=4, fan=3), 3)


def test_sizes_and_nulls(odd_docs, odd_rows):
    got = {(r.doc_id, r.size) for r in sharding.balanced_shards(odd_docs, 5).collect()}
    assert (300, 16) in got and (301, 16) in got and (303, 200_016) in got


def test_clashing_columns_and_empty_table(clashing_docs, odd_rows, no_docs):
    check(odd_rows, collected(clashing_docs, odd_rows, 4), 4)
    assert sharding.balanced_shards(no_docs, 4).count() == 0


def test_difference_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 5_000).tolist()
    sets, sums = sharding.difference(sizes, 40)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 5
    assert [sum(s for s, x in zip(sizes, sets, strict=True) if x == j) for j in range(40)] == sums.tolist()


def test_difference_of_parts_and_nothing():
    parts = [np.array([9, 4, 0]), np.array([5, 5, 1]), np.array([7, 2, 2])]
    sets, sums = sharding.difference(parts, 3)
    assert sorted(np.bincount(sets, np.concatenate(parts), 3).astype(int).tolist()) == sorted(sums.tolist())
    assert all(sorted(sets[i : i + 3].tolist()) == [0, 1, 2] for i in (0, 3, 6))
    assert sharding.difference([], 3)[1].tolist() == [0, 0, 0]
    assert sharding.difference([5], 1)[1].tolist() == [5]


def differencing(sizes, k):
    """Karmarkar-Karp by the book: lists of (sum, members), the two of largest spread added in opposite order."""
    parts = [sorted([(s, [i]), *[(0, [])] * (k - 1)], key=lambda x: -x[0]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b, *rest = parts
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        parts = [*rest, sorted(both, key=lambda x: -x[0])]
    return parts[0]


def test_differencing_equals_plain_code():
    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (7, 2), (40, 3), (60, 5), (200, 4)):
        # sizes and their differences all differ, so that no tie leaves a choice
        sizes = (rng.permutation(n) * 1_000_003 + rng.integers(1, 10**6, n) ** 2).tolist()
        sets, sums = sharding.difference(sizes, k)
        want = differencing(sizes, k)
        assert sums.tolist() == [s for s, _ in want]
        assert [sorted(np.flatnonzero(sets == j).tolist()) for j in range(k)] == [sorted(m) for _, m in want]


def test_query_is_balanced_on_whole_table(spark, sf_dir):
    """Groups of equal texts against plain differencing of their sizes: the same sums, and nothing but groups in a shard."""
    from gridlens.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    groups: dict = {}
    for _, t in docs:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    got = queries.op1_sharding(spark, sf_dir).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.size
    want = [s for s, _ in differencing(sorted(groups.values(), reverse=True), 40)]
    assert len(got) == len(docs) and sum(sums.values()) == sum(want)
    assert max(sums.values()) - min(sums.get(k, 0) for k in range(40)) <= max(want) - min(want) + max(groups.values()) // 100
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)

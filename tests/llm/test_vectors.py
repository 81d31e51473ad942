import brute
import numpy as np
import pytest
from gridlens.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed=0, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=12)
        rows.append((i, base.tolist(), int(rng.integers(0, 3))))
        for k in range(int(rng.integers(0, 3))):
            rows.append((1000 * (k + 1) + i, (base * rng.uniform(0.1, 5) + rng.normal(size=12) * rng.uniform(0, 0.4)).tolist(), rows[-1][2]))
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None, 1), (9002, [0.0] * 12, 1), (9003, [nan] + [1.0] * 11, 1), (9004, [inf] * 12, 1), (9005, [None] + [1.0] * 11, 1), (9006, rows[0][1], None), (9007, [], 1), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1), (9010, [-0.0] + [1.0] * 11, 2), (9011, [0.0] + [1.0] * 11, 2)]
    rows += [(9100 + i, [1.0] * 12, 0) for i in range(40)] + [(9200, [1.0] * 12, 0)] * 2
    rows += [(9300, [3e38] * 12, 0), (9301, [1e-38] * 12, 0)]
    return [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows]


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 7])
def test_equals_brute_force(spark, block):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted(tuple(r) for r in embed_dedup.linked_vectors(df, 0.93, block).collect())
    assert got == sorted(brute.vector_links(rows, 0.93))
    assert sum(r[1] for r in got) > 1000


def test_one_dense_group(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.1).astype(np.float32).tolist(), 1) for i in range(300)]
    got = sorted(tuple(r) for r in embed_dedup.linked_vectors(spark.createDataFrame(rows, SCHEMA), 0.93, 32).collect())
    assert got == sorted(brute.vector_links(rows, 0.93))


def test_empty_and_clashing(spark):
    assert embed_dedup.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embed_dedup.linked_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()[0][1:] == (0, 1, True)
    rows = rows_of(1, 40)
    wide = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", node string, block string, kept int")
    assert sorted(tuple(r) for r in embed_dedup.linked_vectors(wide, 0.93, 16).collect()) == sorted(brute.vector_links(rows, 0.93))

import random

import pytest

CLASHING = ["shard", "slot", "size", "node", "row", "bucket", "score", "component", "epoch", "tie", "leaks", "tokens"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "omega", "kappa"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), f"src{i % 7}", 1) for i in range(60)]
    rows += [(100 + i, base, "en", "src0", None) for i in range(30)]
    for i in range(12):
        w = base.split()
        w[10 + i] = "changed"
        rows.append((200 + i, " ".join(w), "en", "src0", 2))
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, "no id here", "en", "src2", 1), (None, None, None, None, None)]
    rows += [(302, "same same", "en", "src3", 1)] * 3
    rows += [(303, "x" * 200_000, "en", "src4", 1), (304, "   \n\t ", "fr", "src5", 1), (305, words(rng, 30_000), "en", "src0", 1), (306, "one", "en", "src6", 1), (307, "日本 語　text é <|endoftext|> don't", "en", "src6", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_rows):
    """The same with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *["c"] * len(CLASHING)) for r in odd_rows], SCHEMA + "".join(f", {c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

import random
import zlib

import numpy as np
import pytest
from gridlens.llm import quality, toxicity


def good_text(rng, n):
    return " ".join(rng.choice(["the", "meeting", "garden", "river", "was", "quiet", "and", "people", "walked", "slowly"]) for _ in range(n))


def junk_text(rng, n):
    return " ".join(rng.choice(["buy###", "now&&&", "click$$$", "w1n%%%", "free***", "4ll###"]) for _ in range(n))


def insulting(rng, n):
    w = good_text(rng, n).split()
    word = rng.choice(["blockhead", "dimwit", "scoundrel"])
    style = rng.randint(0, 2)
    word = word if style == 0 else "-".join(word) if style == 1 else word[:3] + "*" + word[3:]
    w.insert(rng.randrange(len(w)), word)
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = junk_text(rng, rng.randint(5, 60)) if bad else insulting(rng, rng.randint(5, 60)) if toxic else good_text(rng, rng.randint(5, 60))
        docs.append((i, text))
        if i < 800:
            labels.append((i, int(not bad), int(toxic and not bad)))
    docs += [(2000, None), (2001, ""), (None, "no id"), (None, None), (2002, "long " * 50_000), (2003, "same"), (2003, "same")]
    labels += [(None, 1, 0), (5, None, None), (6, 7, 7), (9999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("scores", "label", "threshold"), [(quality.quality_scores, "quality", 0.7), (toxicity.toxicity_scores, "toxic", 0.3)])
def test_held_out_accuracy(tables, scores, label, threshold):
    docs, labels = tables
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id is not None and r[label] in (0, 1)}
    rows = scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) >= 0.95 and len(tested) > 100


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_labels_of_held_out_rows_and_ids_do_not_count(tables, scores):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumns({c: F.when(quality.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    key = lambda df: sorted((r.doc_id or -1, round(r.score, 9)) for r in df.collect())
    assert key(scores(docs, labels)) == key(scores(docs, turned))


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_empty_tables_and_clashing_columns(spark, tables, scores):
    docs, labels = tables
    assert scores(docs.limit(0), labels).count() == 0
    none = scores(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    from pyspark.sql import functions as F

    wide = docs.withColumns({c: F.lit("x") for c in ("score", "held_out", "row", "y", "quality", "lang")})
    assert sorted(map(str, scores(wide, labels).collect())) == sorted(map(str, scores(docs, labels).collect()))


def test_keep_good_keeps_rows_whole(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    wide = docs.withColumns({c: F.lit(None).cast("string") for c in ("score", "row", "leaks")})
    scored = {(r.doc_id, r.text) for r in quality.quality_scores(docs, labels).join(docs, "doc_id").where("predicted = 1").collect()}
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns
    assert {(r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()} == scored


def fitted(spark, module, rows, label):
    """The model of a module from (text, label) rows."""
    ids = [i for i in range(4 * len(rows)) if not held(i)][: len(rows)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows, strict=True)], "doc_id long, text string")
    return module.fitted(docs, spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows, strict=True)], f"doc_id long, {label} int"))


@pytest.mark.parametrize("turned", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひ"])
def test_gaps_are_tolerated(spark, turned):
    """In Latin script and in others."""
    rng = random.Random(7)
    say = lambda t: t.translate({ord(a): b for a, b in zip("abcdefghijklmnopqrstuvwxyz", turned[:26], strict=True)})
    rows = [(say(insulting(rng, 30)), 1) for _ in range(150)] + [(say(good_text(rng, 30)), 0) for _ in range(150)]
    rng.shuffle(rows)
    m = fitted(spark, toxicity, rows, "toxic")
    clean = [m.score(say(good_text(rng, 30))) for _ in range(50)]
    gapped = [m.score(say(good_text(rng, 10)) + " " + "_".join(say("scoundrel")) + " " + say(good_text(rng, 10))) for _ in range(50)]
    assert np.mean(np.array(gapped) > max(np.percentile(clean, 95), 0.3)) > 0.9


def test_toxic_text_counts_wherever_it_stands(spark):
    """Labelled texts whose only insult lies tens of thousands of characters on: learnt and found."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        t = good_text(rng, rng.randint(4000, 6000))
        rows.append((t + " " + "blockhead" + " " + good_text(rng, 20) if i % 2 else t, i % 2))
    m = fitted(spark, toxicity, rows, "toxic")
    assert m.score(good_text(rng, 8000) + " blockhead " + good_text(rng, 8000)) > 0.5 > m.score(good_text(rng, 16_000))


def test_scores_are_those_of_plain_code(spark, tables):
    """Each row's score against the definition, symbol by symbol and block by block, on whole texts."""
    import zstandard

    docs, labels = tables
    m = toxicity.fitted(docs, labels)

    def decision(text):
        s = toxicity.symbols(text).tolist()
        at = []
        for i in range(len(s) - 2 * toxicity.P):
            total = 0.0
            for skip, weight in zip(toxicity.SKIPS, toxicity.WEIGHTS, strict=True):
                code = 0
                for k in skip:
                    code = code * toxicity.SYMBOLS + s[i + k]
                total += weight * float(m.table[code])
            at.append(total)
        width = min(toxicity.WIDTH, len(at))
        return max(sum(at[i : i + width]) for i in range(len(at) - width + 1)) + m.bias

    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and len(r.text or "") < 2000}
    a, b = m.curve
    for r in toxicity.toxicity_scores(docs, labels).where("doc_id % 9 = 0 or doc_id >= 2000").collect():
        if r.doc_id in texts:
            assert abs(r.score - 1 / (1 + np.exp(-(a + b * (decision(texts[r.doc_id]) - m.middle) / m.scale)))) < 1e-4
    q = quality.fitted(docs, labels)
    for r in quality.quality_scores(docs, labels).collect():
        if r.doc_id in texts:
            raw, sums = (texts[r.doc_id] or "").encode(), {}
            for y in (0, 1):
                pack = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(q.raw[y]), write_content_size=False, write_dict_id=False)
                sums[y] = sum(len(pack.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK))
            x = (sums[0] - sums[1]) / (len(raw) + 2 * sum(sums.values())) if raw else 0.0
            # a prepared dictionary may cut the sequences otherwise than one that is loaded
            assert abs(r.score - 1 / (1 + np.exp(-(q.curve[0] + q.curve[1] * (x - q.middle) / q.spread)))) < 0.05


@pytest.mark.parametrize(("scores", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_are_calibrated(spark, tables, scores, label):
    """On rows that are held out the mean score is near the share of ones, and so it is above and below 0.5."""
    docs, labels = tables
    rows = scores(docs, labels).where("held_out").join(labels.where(f"{label} in (0, 1)"), "doc_id").select("score", label).collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert len(y) > 100 and abs(s.mean() - y.mean()) < 0.05 and np.mean((s - y) ** 2) < 0.05
    for part in (s >= 0.5, s < 0.5):
        assert abs(s[part].mean() - y[part].mean()) < 0.1


def test_table_is_the_kernel_machine():
    """The tabulated decision is that of the Nystroem features."""
    rng = random.Random(3)
    a, b = toxicity.symbols(good_text(rng, 4)), toxicity.symbols(insulting(rng, 4))
    phi = []
    for s in (a, b):
        f = {}
        for skip, w in zip(toxicity.SKIPS, toxicity.WEIGHTS, strict=True):
            for i in range(len(s) - 2 * toxicity.P):
                k = tuple(int(s[i + d]) for d in skip)
                f[k] = f.get(k, 0) + w
        phi.append(f)
    want = sum(v * phi[1].get(k, 0) for k, v in phi[0].items())
    (ca, wa), (cb, wb) = toxicity.ToxicityModel._features([a, b])
    got = sum(x * y for c, x in zip(ca, wa, strict=True) for d, y in zip(cb, wb, strict=True) if c == d)
    assert abs(got - want) < 1e-9


def test_dictionaries_hold_more_than_openings(spark):
    rng = random.Random(8)
    opening = ("all rights reserved " * 52)[: quality.PIECE]  # a piece that all texts share
    texts = [opening + "".join(rng.choices("abcdefgh ", k=3 * quality.PIECE)) for _ in range(1100)]
    made = quality.dictionary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(made) == quality.DICTIONARY and made.count(opening.encode()) < 800
    # of a longer text pieces from all over it, and never more than there are
    whole = "".join(f"{k:05d}" for k in range(700_000))
    (docs,) = [spark.createDataFrame([(1, whole), (2, ""), (3, "é")], "doc_id long, text string")]
    made = quality.dictionary(docs).decode()
    places = {whole.find(made[k : k + quality.PIECE]) // 500_000 for k in range(0, len(made) - quality.PIECE, quality.PIECE)}
    assert len(places - {-1}) >= 6
    assert quality.dictionary(docs.limit(0)) == b""


def test_labelled_rows_are_whole_and_bounded(spark):
    from gridlens.llm.common import Scratch

    long = "word " * 100_000
    docs = spark.createDataFrame([(i, long if i == 4 else f"text {i}") for i in range(200)] + [(4, long), (None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality", 3, 1000, Scratch(spark, "t")).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sum(not held(i) for i in range(200))
    assert {r.text for r in rows if r.doc_id == 4} == {long} and 0 < sum(r.curve for r in rows) < len(rows) / 2
    assert quality.labelled(docs, labels, "quality", 3, 10, Scratch(spark, "t")).count() == 20

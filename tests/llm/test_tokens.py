import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from gridlens.llm import token_counts, token_store
from gridlens.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def stored(docs, **options):
    scratch = Scratch(docs.sparkSession, "t")
    return token_store.read_tokens(*token_store.write_tokens(docs, BYTES, scratch, **options))


@pytest.mark.parametrize("shard", [token_store.SHARD, 500])
def test_files_hold_all_ids(odd_docs, odd_rows, shard):
    got = sorted(stored(odd_docs, shard=shard).collect(), key=lambda r: r.start)
    want = brute.token_rows([r[:2] for r in odd_rows], token_counts.tokenizer(BYTES))
    ids = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == [w[0] for w in sorted(want, key=lambda w: ids(w[0]))]
    assert sorted(r.n_tokens for r in got) == sorted(w[2] for w in want)
    assert sorted(r.ids_crc32 for r in got) == sorted(w[3] for w in want)
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.start for r in got] == ends[:-1]


def test_many_ranges(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_ROWS", 7)
    got = sorted(stored(odd_docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got][1:] == np.cumsum([r.n_tokens for r in got]).tolist()[:-1]


def test_clashing_columns_and_empty_table(clashing_docs, odd_rows, no_docs):
    assert stored(clashing_docs).count() == len(odd_rows)
    assert stored(no_docs).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.4, 5_000).clip(0, 50_000).astype(np.uint16)
    old, token_store.BLOCK = token_store.BLOCK, 1 << 10
    try:
        m = token_store.WaveletMatrix(token_store.WaveletMatrix.build(ids, [5, None], np.array([4_000, 5_000])))
        assert (m.decode() == ids).all()
        assert [m.access(i) for i in range(0, 5_000, 37)] == ids[::37].tolist()
        for t in (1, 2, 3, 50_000, 60_001, 1 << 17, -1):
            at = np.flatnonzero(ids == t).tolist()
            assert m.count(t) == len(at) and list(m.occurrences(t)) == at
            assert m.count(t, 100, 900) == sum(100 <= i < 900 for i in at)
        with pytest.raises(IndexError):
            m.select(1, 10_000)
        with pytest.raises(IndexError):
            m.access(5_000)
        assert [(d, a, len(x)) for d, a, x in m.documents()] == [(5, 0, 4_000), (None, 4_000, 1_000)]
    finally:
        token_store.BLOCK = old
    empty = token_store.WaveletMatrix(token_store.WaveletMatrix.build(np.empty(0, np.uint16), [], np.empty(0)))
    assert empty.count(3) == 0 and len(empty.decode()) == 0
    with pytest.raises(ValueError):
        token_store.WaveletMatrix(b"not one")


def test_pieces_equal_the_library():
    e, rng = token_store.PieceEncoder(BYTES), random.Random(3)
    parts = [*"ab.,' \n\t#é1!?-ß|<>", "'s", " b", ". ", ", ", "don't", "<|endoftext|>", "\x01", "  ", "　", " the", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5_000)]
    got = e.encode(pa.array(texts))
    assert [g.tolist() for g in got] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 20)
    e, rng = token_store.PieceEncoder(BYTES), random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(20)) for _ in range(5)]
        assert [g.tolist() for g in e.encode(pa.array(texts))] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts(odd_docs, odd_rows, path):
    tok = token_counts.tokenizer(path)
    count = (lambda t: len(tok.encode(t))) if path == PIECES else (lambda t: len(tok.encode(t, add_special_tokens=False)))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_docs, path).collect())
    assert got == sorted((d or -1, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for d, t, *_ in odd_rows)


def test_counts_of_clashing_and_no_rows(clashing_docs, odd_rows, no_docs):
    assert token_counts.token_counts(clashing_docs, WORDS).count() == len(odd_rows)
    assert token_counts.token_counts(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_spliced_counts_equal_whole(path):
    tok, rng = token_counts.tokenizer(path), random.Random(6)
    parts = [" the", " Thonti", " of.", ",", "\n", "  ", " don't", " <|endoftext|>", " 123", "é", " 日本語", "x" * 40, "́", " ÉCOLE", "…"]
    for n in (10, 300, 3_000):
        text = "".join(rng.choice(parts) for _ in range(n))
        want = len(tok.encode(text, add_special_tokens=False))
        for chunk, overlap in ((50, 10), (200, 30), (1_000, 64)):
            assert token_counts.count_spliced(tok, text, chunk, overlap) == want
    for text in ("x" * 5_000, "", "a" * 99 + " " + "b" * 3_000):
        assert token_counts.count_spliced(tok, text, 100, 20) == len(tok.encode(text, add_special_tokens=False))


def test_crc_is_of_four_byte_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in stored(docs, end_id=0).collect()}
    assert rows[2].n_tokens == 1 and rows[2].ids_crc32 == zlib.crc32(b"\0\0\0\0") and rows[2].start == rows[1].n_tokens

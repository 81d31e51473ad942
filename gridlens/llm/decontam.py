"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of an item is a seed, whatever its count: rare ones are just those that edited copies of a text with many
copies lost.  One pass finds the seeds in every whole text and aligns the words around them with the item.  An alignment
that scores enough and holds a seed is never cut: the stretch of the text that is aligned is as wide as its gaps can make
it.  What is not found: a copy that shares no three successive words with the item (every third word changed, or a word put
in behind every second one); its best score is then near half of the item's.

How it scales: a map over the documents, which shuffles nothing.  The benchmark is a stated query set: it is taken in
blocks of at most ``BLOCK`` bytes of text, as arrays of word numbers (some 24 bytes a word), and each block is one pass.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, packed, unpacked

N = 3
LEAST = 0.5
BLOCK = 32_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_blank = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_blank).split()


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, position in doc where it ends) by Smith-Waterman; 0 in doc matches nothing.

    A step for each word of the item, over all words of doc at once."""
    now = np.zeros(len(doc) + 1, np.int64)
    steps = np.arange(len(doc) + 1) * -GAP
    best, end = 0, 0
    for w in item.tolist():
        row = np.zeros_like(now)
        row[1:] = np.maximum(np.maximum(now[:-1] + np.where(doc == w, MATCH, MISMATCH), now[1:] + GAP), 0)
        now = np.maximum.accumulate(row + steps) - steps  # words of doc skipped: the best earlier cell less its distance
        at = int(now.argmax())
        if now[at] > best:
            best, end = int(now[at]), at - 1
    return best, end


class Block:
    """A block of benchmark items as arrays: vocabulary, items as word numbers from 1, sorted seeds with their places."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        number = lambda w: self.vocab.setdefault(w, len(self.vocab) + 1)
        self.items = [np.array([number(w) for w in words(t)], np.int32) for _, t in items]
        codes, places = [], []
        for n in range(1, N + 1):  # items of fewer words than N are a seed as a whole
            for k, x in enumerate(self.items):
                if len(x) >= n and (n == N or len(x) == n):
                    codes.append(grams(x, n))
                    places.append(np.column_stack([np.full(len(x) - n + 1, k), np.arange(len(x) - n + 1)]))
        codes = np.concatenate([*codes, np.empty(0, np.uint64)])
        order = np.argsort(codes, kind="stable")
        self.seeds = codes[order]
        self.places = np.concatenate([*places, np.empty((0, 2), np.int64)])[order].astype(np.int32)
        self.lengths = sorted({min(N, len(x)) for x in self.items} - {0})

    def read(self, text: str | None) -> np.ndarray:
        ws, get = words(text), self.vocab.get
        return np.fromiter([get(w, 0) for w in ws], np.int32, len(ws))

    def hits(self, x: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item, the (position in x, in the item) of the seeds in x."""
        out: dict[int, list[tuple[int, int]]] = {}
        for n in self.lengths:
            if len(x) < n:
                continue
            known = np.flatnonzero(np.logical_and.reduce([x[k : len(x) - n + 1 + k] > 0 for k in range(n)]))
            if not len(known):
                continue
            g = grams(x, n)[known]
            low = np.searchsorted(self.seeds, g)
            hit = self.seeds[np.minimum(low, len(self.seeds) - 1)] == g
            high = np.searchsorted(self.seeds, g[hit], side="right")
            for at, a, b in zip(known[hit].tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for k, p in self.places[a:b].tolist():
                    out.setdefault(k, []).append((at, p))
        return out


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on.  Two n-grams of one hash cost an alignment and are told apart by it."""
    out = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (x[k : len(x) - n + 1 + k].astype(np.uint64) * _MIX[k])) * _MIX[2]
        out ^= out >> np.uint64(29)
    return out


def _regions(hits: list[tuple[int, int]], size: int, length: int, least: float) -> list[tuple[int, int]]:
    """Stretches of a document in which an alignment of score ``least`` through one of the hits (position there, in the item)
    can lie: of its 2 * size at best, each word skipped costs 1."""
    slack = int(MATCH * size * (1 - least)) + 1
    out: list[list[int]] = []
    for at, p in sorted(hits):
        low, high = max(0, at - p - slack), min(length, at + (size - p) + slack)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def leaks_of(block: Block, x: np.ndarray, least: float) -> list[tuple[int | None, float, int, int]]:
    """(item_id, score, first word, word after the last) of the items that a text, as word numbers, holds."""
    out = []
    for item, hits in sorted(block.hits(x).items()):
        want = block.items[item]
        best = (0.0, 0, 0)
        for low, high in _regions(hits, len(want), len(x), least):
            part = x[low:high]
            if np.isin(want, part).sum() < least * len(want):  # a match counts MATCH at most: no alignment can do it
                continue
            score, end = align(part, want)
            score /= MATCH * len(want)
            if score >= max(least, 1.0 if len(want) < N else 0.0) and score > best[0]:
                back, last = align(part[: end + 1][::-1], want[::-1])  # the start is the end of the reverse
                best = (score, low + end - last, low + end + 1)
        if best[0]:
            out.append((block.ids[item], float(best[0]), int(best[1]), int(best[2])))
    return out


def blocks_of(benchmark: DataFrame, size: int = BLOCK):
    """The items in blocks of about ``size`` bytes of text, dealt by hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // size))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield Block(sorted(((r.item_id, r.text) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def with_leaks(rows: DataFrame, benchmark: DataFrame, least: float = LEAST, block_bytes: int = BLOCK, inside: str | None = None) -> DataFrame:
    """``rows`` with column ``leaks array<struct<item_id, score, first_word, end_word>>``; text as in :func:`map_text`."""
    out, names = rows, []
    for number, block in enumerate(blocks_of(benchmark, block_bytes)):

        def find(block=block):
            def run(texts):
                found = [leaks_of(block, block.read(t), least) for t in texts]
                return [[[dict(zip(("item_id", "score", "first_word", "end_word"), x, strict=True)) for x in f] for f in found]]

            return run

        names.append(f"leaks_{number}")
        add = f"{names[-1]} array<struct<item_id:bigint,score:double,first_word:bigint,end_word:bigint>>"
        if not inside:
            out = out.withColumn("text_again", F.col("text")) if "text_again" not in out.columns else out
            out = map_text(out, find, add).withColumn("text", F.col("text_again"))
        else:
            out = map_text(out, find, add, inside=inside)
    return out.withColumn("leaks", F.concat(*names)).drop(*names, "text_again")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for each row of ``docs(doc_id, text)`` and item of
    ``benchmark(item_id, text)`` that it holds.

    score: Smith-Waterman score of the words (match 2, mismatch and gap -1) over that of the whole item, at least
    ``least``, of alignments that hold three successive words of the item.  The words of the best place, first_word to
    end_word - 1, are given.  Null and empty texts hold nothing; an item of fewer than 3 words is held where all its words
    follow each other, an item without words by nothing.  Repeated rows and items each give rows of their own.  Other
    columns are not read.  Either table may be empty: the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_leaks(rows, benchmark, least, block_bytes)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all its columns whatever their names."""
    return unpacked(with_leaks(packed(docs), benchmark, least, inside="text").where(F.size("leaks") == 0))

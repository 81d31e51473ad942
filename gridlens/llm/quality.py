"""Quality by compression: zstandard dictionaries of good and of bad text, and the difference of the compressed sizes.

Text is compressed in blocks of ``BLOCK`` bytes with either dictionary, every block of the whole text.  The difference of
the two sums, normalised by the text's length and the sums themselves, goes into a logistic curve fitted on labelled rows
that the dictionaries have not seen, moved to the share of good rows among all labelled ones: the score.  (Over the sums
alone, text that repeats itself, which both compress to nothing, differs as much as any; over the length alone, short text
counts less.  Low levels index too little of a dictionary for blocks of this size.)

How it scales: fitting takes at most ``PER_CLASS`` labelled rows of each class (by hash of doc_id, so a bigger corpus gives as
many) with their whole texts, in a table of their own.  Blocks from all over them are collected up to the size of the
dictionaries, then one number of each row for the curve.  Scoring is a map.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_text, packed, unpacked

PER_CLASS = 1_500
BLOCK = 512
PIECE = 1_024  # characters of a text that go into a dictionary together
DICTIONARY = 2 << 20
LEVEL = 7
CURVE = 3  # a third of the labelled rows is for the curve


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, curve: int, per_class: int, scratch: Scratch) -> DataFrame:
    """(doc_id, y, text, curve): whole texts of at most per_class rows a class that are not held out, chosen by a hash of doc_id,
    in a table of their own.  curve: one in so many rows, for the curve and not for the model."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    few = [known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = F.broadcast(few[0].union(few[1]))  # at most 2 * per_class rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    # rows of one doc_id count once, so repeated rows cannot break the bound
    rows = text.join(few, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return scratch.table(rows.withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(curve)) == 0), "labelled")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (intercept first) of a logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    """Two dictionaries and a curve.  Without them every score is the share of good rows."""

    def __init__(self, share: float, raw: dict[int, bytes] | None = None):
        self.share, self.raw, self.curve = share, raw, None
        if raw is not None:
            self._open()

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        self.middle, self.spread = float(x.mean()), float(x.std()) + 1e-9
        self.curve = logistic(((x - self.middle) / self.spread)[:, None], y)
        # the sample has about as many of either class; the curve is moved to the share among all labelled rows
        self.curve[0] += log_odds(self.share) - log_odds(float(y.mean()))

    def _open(self) -> None:
        self.pack, options = {}, {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        for y, raw in self.raw.items():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pack[y] = zstandard.ZstdCompressor(dict_data=d, **options)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pack"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.raw is not None:
            self._open()

    def difference(self, text: str | None) -> float:
        """Normalised difference of the compressed sizes, positive if good text's dictionary serves better; 0 without text."""
        good = bad = size = 0
        for b in blocks(text, BLOCK):
            good += len(self.pack[1].compress(b))
            bad += len(self.pack[0].compress(b))
            size += len(b)
        return (bad - good) / (size + 2 * (bad + good)) if size else 0.0

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.curve is None or not texts:
            return [self.share] * len(texts)
        x = (np.array([self.difference(t) for t in texts]) - self.middle) / self.spread
        return (1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x, -30, 30)))).tolist()


def log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def blocks(text: str | None, size: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(rows: DataFrame) -> bytes:
    """Plain content of ``rows(doc_id, text)``: a block of each text, then a second one of each, and so on until it is full; a hash
    of doc_id and block chooses them from all over the text.  (The library's own trainer gives dictionaries of a few hundred
    bytes to all that it may, by chance of the sample.)  At most a dictionary's worth of blocks leaves a text."""
    most = DICTIONARY // PIECE
    n = F.ceil(F.char_length("text") / PIECE).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.xxhash64("doc_id", k).alias("h"), k.alias("k"))))
    places = rows.where("text <> ''").select("text", F.posexplode(F.slice(order, 1, most)).alias("turn", "at"))
    pieces = places.select("turn", "at.h", F.substring("text", F.col("at.k") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    # the turns that fill it, at most ``most`` of them; so no more than a dictionary and one turn's pieces leave the tasks
    room, last = DICTIONARY, -1
    for r in pieces.groupBy("turn").agg(F.sum(F.octet_length("piece")).alias("n")).orderBy("turn").collect():
        if room > 0:
            room, last = room - r.n, r.turn
    parts, size = [], 0
    for r in sorted(pieces.where(F.col("turn") <= last).collect()):
        if size < DICTIONARY:
            parts.append(r.piece.encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
    return b"".join(reversed(parts))[-DICTIONARY:]


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, scratch: Scratch | None = None) -> QualityModel:
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rows, share = labelled(docs, labels, "quality", CURVE, per_class, scratch), share_of(labels, "quality")
    fit, rest = rows.where("not curve"), rows.where("curve")
    counts = {(r.y, r.curve): r.n for r in rows.where("text <> ''").groupBy("y", "curve").agg(F.count("*").alias("n")).collect()}
    if min(counts.get((y, False), 0) for y in (0, 1)) < 8 or min(counts.get((y, True), 0) for y in (0, 1)) < 1:
        model = QualityModel(share)
    else:
        model = QualityModel(share, {y: dictionary(fit.where(F.col("y") == y)) for y in (0, 1)})
        told = map_text(rest.select("doc_id", "y", "text"), lambda: lambda texts: [[model.difference(t) for t in texts]], "x double")
        told = sorted(tuple(r) for r in told.select("doc_id", "y", "x").collect())  # at most 2 * per_class rows of numbers
        model.fit_curve(np.array([x for *_, x in told]), np.array([y for _, y, _ in told], float))
    scratch.drop(rows)
    return model


def share_of(labels: DataFrame, label: str) -> float:
    """The share of ones among all labelled rows that are not held out."""
    y = F.col(label).cast("int")
    r = labels.where(~held_out(F.col("doc_id"))).agg(F.count(F.when(y == 1, 1)).alias("a"), F.count(F.when(y == 0, 1)).alias("b")).first()
    return (r.a + 1) / (r.a + r.b + 2)


def _scores(model: QualityModel):
    return lambda: lambda texts: [model.scores(texts)]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``; other columns are not read.

    Scores depend on the text alone; null and empty texts get the score of no difference.  Null doc_ids are not held
    out.  Labels that are null or neither 0 nor 1 are ignored; a doc_id labelled both ways counts as two rows.  Without
    labelled rows of both classes all scores are equal.  An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = map_text(rows, _scores(fitted(docs, labels, per_class)), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all its columns whatever their names."""
    return unpacked(map_text(packed(docs), _scores(fitted(docs, labels)), "score double", inside="text").where(F.col("score") >= threshold))

"""Toxicity: a support vector machine with a gap-weighted subsequence string kernel and Nystroem landmarks.

Kernel: k(x, y) sums, over all sequences of ``P`` symbols, the products of their weights in x and in y; a sequence weighs
``DECAY`` for each symbol skipped, at most one between two of its own, so inserted characters weaken a match and do not
break it.  Symbols are letters without case, accented letters apart, digits, blanks and other signs; letters of other
scripts than Latin are dealt over the letters' symbols by code point.

Sentences are compared as overlapping windows of ``WIDTH`` symbols.  A labelled text says only that some window of it is
toxic, so the machine is trained in rounds: the best windows of each toxic text against the worst of each clean one.  With
landmarks L and weights w on the Nystroem features K(x, L) K(L, L)^-1/2, the decision is linear in the weights of x's own
sequences; they are tabulated once, and scoring a whole text is a sum of table lookups with the largest window taken.

How it scales: fitting takes at most ``PER_CLASS`` labelled rows a class with their whole texts, in a table of their own (see
quality.labelled).  Each round is a map over it that gives one window of each text; the machine is trained on the windows.
Scoring is a map.
"""

from __future__ import annotations

import unicodedata
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_text
from .quality import held_out, labelled, log_odds, logistic, share_of

P = 4
DECAY = 0.5
WIDTH = 24
LANDMARKS = 256
PER_CLASS = 1_500
PIECE = 1 << 20  # symbols of a long text at a time
CURVE = 4  # a quarter of the labelled rows is for the curve
ROUNDS = 4
LEAST = 0.5  # of the margin
WINDOWS = 4  # of a labelled text, to learn from
SYMBOLS = 32


def _alphabet() -> np.ndarray:
    """Symbol of each code point below 65536: 0 blank, 1-26 letters, 27-29 accented letters, 30 digits, 31 other."""
    out = np.full(65_536, 31, np.uint32)
    for c in range(0x300, 65_536):
        ch = chr(c)
        if ch.isspace():
            out[c] = 0
        elif ch.isdigit():
            out[c] = 30
        elif ch.isalpha():
            out[c] = 1 + ord(ch.lower()[0]) * 0x9E3779B1 % (1 << 32) % 29
    for c in range(0x300):
        ch = chr(c)
        low = unicodedata.normalize("NFD", ch.lower())
        if ch.isspace():
            out[c] = 0
        elif "a" <= low[:1] <= "z":
            out[c] = ord(low[0]) - 96 if len(low) == 1 else 27 if low[0] == "e" else 28 if low[0] == "a" else 29
        elif ch.isalpha():
            out[c] = 29
        elif ch.isdigit():
            out[c] = 30
    return out


ALPHABET = _alphabet()
SKIPS = [np.cumsum([0, *[1 + g for g in gaps]]).tolist() for gaps in product((0, 1), repeat=P - 1)]
WEIGHTS = [DECAY ** (s[-1] - P + 1) for s in SKIPS]


def symbols(text: str | None) -> np.ndarray:
    """A text's symbols with blanks around, so that words at its ends have borders too."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 2 + 2 * P, np.uint32)
    out[1 : 1 + len(points)] = ALPHABET[np.minimum(points, 65_535)]  # 65535 is no letter
    return out


def sequences(s: np.ndarray, skip: list[int]) -> np.ndarray:
    """The code of the sequence that begins at each position, for one way of skipping."""
    n = len(s) - 2 * P
    code = s[:n].copy()
    for k in skip[1:]:
        code = code * SYMBOLS + s[k : k + n]
    return code


class ToxicityModel:
    """Without a trained table every score is the share of toxic rows."""

    def __init__(self, share: float):
        self.share, self.table, self.bias, self.curve = share, None, None, None

    def contrast(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> None:
        """To begin with: how much more often a sequence stands in toxic texts than in clean ones, from the numbers of texts."""
        a, b = toxic / n_toxic, clean / n_clean
        self.table = ((a - b) / np.sqrt((a + b) / 2 * (1 / n_toxic + 1 / n_clean) + 1e-4)).clip(0).astype(np.float32) ** 2

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        self.middle, self.scale = float(x.mean()), float(x.std()) or 1.0
        w = logistic((x[:, None] - self.middle) / self.scale, y, penalty=0.05)
        # the sample has about as many of either class; the curve is moved to the share among all labelled rows
        self.curve = [float(w[0] + log_odds(self.share) - log_odds(float(y.mean()))), float(w[1])]

    def _positions(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(s) - 2 * P), np.float32)
        for skip, weight in zip(SKIPS, WEIGHTS, strict=True):
            out += np.float32(weight) * self.table[sequences(s, skip)]
        return out

    def _windows(self, s: np.ndarray) -> np.ndarray:
        """The sum over each window."""
        total = np.concatenate([[0.0], np.cumsum(self._positions(s), dtype=np.float64)])
        width = min(WIDTH, len(total) - 1)
        return total[width:] - total[: len(total) - width]

    def best(self, s: np.ndarray, most: int = 1) -> list[tuple[float, np.ndarray]]:
        """(sum, symbols) of the windows with the largest sums, largest first, none over another; in pieces that overlap by a
        window."""
        found: list[tuple[float, int]] = []
        for low in range(0, max(1, len(s) - 2 * P - WIDTH + 1), PIECE):
            sums = self._windows(s[low : low + PIECE + WIDTH + 2 * P])
            for _ in range(min(most, len(sums))):
                at = int(sums.argmax())
                if sums[at] == -np.inf:
                    break
                found.append((float(sums[at]), low + at))
                sums[max(0, at - WIDTH + 1) : at + WIDTH] = -np.inf
        out = []
        for value, at in sorted(found, key=lambda f: (-f[0], f[1]))[:most]:
            window = s[at : at + WIDTH + 2 * P]
            out.append((value, np.concatenate([window, np.zeros(max(0, 4 * P - len(window)), np.uint32)])))
        return out

    def examples(self, text: str, y: int) -> list[bytes]:
        """The windows of a labelled text to learn from: the best two of a clean text, of a toxic one the best and those others that
        the machine takes for toxic too, halfway to its margin (before it is trained: that come near the best).  Long texts have
        many windows just over the border, which a lower limit would teach as toxic."""
        found = self.best(symbols(text), WINDOWS)
        least = found[0][0] / 2 if self.bias is None else LEAST - self.bias
        return [w.tobytes() for k, (value, w) in enumerate(found) if k == 0 or (k < 2 if y == 0 else value > least)]

    @staticmethod
    def _features(windows) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes, weights) of each window's sequences."""
        out = []
        for s in windows:
            codes = [sequences(s, k) for k in SKIPS]
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            out.append((code, np.bincount(back, np.concatenate([np.full(len(c), w) for c, w in zip(codes, WEIGHTS, strict=True)]))))
        return out

    def train(self, toxic: list[np.ndarray], clean: list[np.ndarray]) -> None:
        """A new table from one window of each text."""
        f = self._features([*toxic, *clean])
        y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
        half = LANDMARKS // 2
        spread = lambda a, n, k: [a + int(i) for i in np.unique(np.linspace(0, n - 1, min(k, n)).astype(int))]
        chosen = spread(0, len(toxic), half) + spread(len(toxic), len(clean), half)
        codes = np.unique(np.concatenate([f[i][0] for i in chosen]))
        phi = np.zeros((len(chosen), len(codes)))  # landmarks by sequences
        for r, i in enumerate(chosen):
            phi[r, np.searchsorted(codes, f[i][0])] = f[i][1]
        kernel = np.zeros((len(f), len(chosen)))
        for r, (c, w) in enumerate(f):
            at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            hit = codes[at] == c
            kernel[r] = phi[:, at[hit]] @ w[hit]
        own = phi @ phi.T
        scale = np.trace(own) / len(own)
        values, vectors = np.linalg.eigh(own / scale + 1e-3 * np.eye(len(own)))
        root = vectors / np.sqrt(values) @ vectors.T
        w = svm(kernel / scale @ root, y)
        self.bias = float(w[-1])
        self.table = np.zeros(SYMBOLS**P, np.float32)
        self.table[codes] = (phi.T @ (root @ w[:-1]) / scale).astype(np.float32)

    def decision(self, text: str | None) -> float:
        """The machine's largest decision over the windows of a whole text."""
        return self.best(symbols(text))[0][0] + self.bias

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return self.share
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * (self.decision(text) - self.middle) / self.scale, -30, 30))))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss, by Newton steps on the primal."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6  # the bias is not shrunk
    w = np.zeros(x.shape[1])
    active = np.zeros(len(x), bool)
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
        a = x[active]
        w = np.linalg.solve(keep + 2 * cost * a.T @ a, 2 * cost * a.T @ y[active])
    return w


def _seen(rows: DataFrame, tasks: int = 8) -> dict[int, np.ndarray]:
    """By label, in how many texts each sequence without gaps stands."""

    def count(frames):
        seen = {y: np.zeros(SYMBOLS**P, np.float32) for y in (0, 1)}
        for f in frames:
            for y, text in zip(f["y"], f["text"], strict=True):
                s = symbols(text)
                codes = [np.unique(sequences(s[low : low + PIECE + 2 * P], SKIPS[0])) for low in range(0, max(1, len(s) - 2 * P), PIECE)]
                seen[y][np.unique(np.concatenate(codes))] += 1
        for y, n in seen.items():
            codes = np.flatnonzero(n).astype(np.int32)
            yield pd.DataFrame({"y": [y], "codes": [codes.tobytes()], "counts": [n[codes].tobytes()]})

    out = {y: np.zeros(SYMBOLS**P, np.float32) for y in (0, 1)}
    for r in rows.select("y", "text").coalesce(tasks).mapInPandas(count, "y int, codes binary, counts binary").collect():  # 8 MB a task at most
        out[r.y][np.frombuffer(r.codes, np.int32)] += np.frombuffer(r.counts, np.float32)
    return out


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, scratch: Scratch | None = None) -> ToxicityModel:
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    rows, model = labelled(docs, labels, "toxic", CURVE, per_class, scratch), ToxicityModel(share_of(labels, "toxic"))
    counts = {(r.y, r.curve): r.n for r in rows.groupBy("y", "curve").agg(F.count("*").alias("n")).collect()}
    if min(counts.get((y, False), 0) for y in (0, 1)) >= 4 and min(counts.get((y, True), 0) for y in (0, 1)) >= 1:
        fit, rest = rows.where("not curve").select("doc_id", "y", "text"), rows.where("curve").select("doc_id", "y", "text")
        seen = _seen(fit)
        model.contrast(seen[1], seen[0], counts[1, False], counts[0, False])
        clean: set[bytes] = set()  # of all rounds: a machine that forgot some would take them up again
        for _ in range(ROUNDS):
            learn = lambda: lambda texts, ys: [[model.examples(t, y) for t, y in zip(texts, ys.to_pylist(), strict=True)]]
            found = map_text(fit, learn, "windows array<binary>", given=("y",))
            found = sorted((r.y, r.doc_id, k, bytes(w)) for r in found.collect() for k, w in enumerate(r.windows))  # at most WINDOWS a row
            clean |= {w for y, *_, w in found if y == 0}
            model.train(*[[np.frombuffer(w, np.uint32) for w in ws] for ws in ([w for y, *_, w in found if y], sorted(clean))])
        told = map_text(rest, lambda: lambda texts: [[model.decision(t) for t in texts]], "x double")
        told = sorted(tuple(r) for r in told.select("doc_id", "y", "x").collect())
        model.fit_curve(np.array([x for *_, x in told]), np.array([y for _, y, _ in told], float))
    scratch.drop(rows)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``; other columns are not read.

    Scores depend on the text alone; null and empty texts are scored like a blank.  Null doc_ids are not held out.  Labels
    that are null or neither 0 nor 1 are ignored.  Without labelled rows of both classes all scores are equal.  An empty
    table gives an empty table.
    """
    model = fitted(docs, labels, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = map_text(rows, lambda: lambda texts: [[model.score(t) for t in texts]], "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

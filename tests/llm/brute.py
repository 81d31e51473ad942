"""Plain versions of the operators, to hold results against."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash


def components(nodes: list, links: list[tuple]) -> dict:
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def simhash(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_classes(docs: list[tuple[int, str | None]], width: int, most: int) -> dict:
    prints = [simhash(t, width) for _, t in docs]
    distinct = np.array(sorted(set(prints)), np.uint64)
    links = []
    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ x) <= most):
            links.append((int(x), int(distinct[i + 1 + j])))
    cls = components([int(x) for x in distinct], links)
    least: dict[int, int] = {}
    for (d, _), f in zip(docs, prints, strict=True):
        if d is not None:
            least[cls[f]] = min(d, least.get(cls[f], d))
    return [(d, f"{f:016x}", least.get(cls[f])) for (d, _), f in zip(docs, prints, strict=True)]


def shingle_set(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar_pairs(docs: list[tuple[int, str | None]], width: int) -> list[tuple[int, int, float]]:
    """Pairs of rows with a shingle in common, or equal sets, and their Jaccard similarity."""
    sets, seen, out = [shingle_set(t, width) for _, t in docs], {}, {}
    for i, s in enumerate(sets):
        for g in s:
            seen.setdefault(g, []).append(i)
    for rows in seen.values():
        for x, a in enumerate(rows):
            for b in rows[x + 1 :]:
                if (a, b) not in out:
                    out[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return [(a, b, j) for (a, b), j in out.items()]


def turns(rows: list[tuple]) -> dict:
    """conv_id -> the digests of (conv_id, turn, role, text) rows."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, ts in by.items():
        ts.sort()
        every = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        learnt = "".join(t for *_, r, t in ts if r == "assistant")
        out[conv] = (len(ts), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def token_rows(docs: list[tuple], tok) -> list[tuple]:
    at, out = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def vector_links(rows: list[tuple], least: float) -> list[tuple]:
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and fine(v)]
    links, n = [], [0] * len(rows)
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            if rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
                continue
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    cls = components(list(range(len(rows))), links)
    low: dict = {}
    for i, (v, *_) in enumerate(rows):
        low[cls[i]] = min(v, low.get(cls[i], v))
    return [(rows[i][0], n[i], low[cls[i]], rows[i][0] == low[cls[i]]) for i in range(len(rows))]

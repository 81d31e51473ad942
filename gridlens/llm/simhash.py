"""Near-duplicates with pigeonring filtering: SimHash for Hamming distances, MinHash for similarities.

Two relations.  ``hamming``: 64-bit SimHash fingerprints of word shingles that differ in at most ``bits`` bits.
``similarity``: documents whose shingle sets have a Jaccard similarity of at least ``similarity``.  A 64-bit SimHash at 0.8
differs in about 10 of 64 bits, which no index can search; so no SimHash and no Hamming distance takes part there, but
``CELLS`` MinHash segments (the least hash of each cell of the shingles), equal or not.

Pigeonring: lay the m segments on a ring.  If two fingerprints differ by at most t in all, some segment begins a chain in
which the first l segments differ by at most l * t / m, for every l.  The opening run where that budget is 0 must be
equal, so it is the join key (one for each of the m starts).  ``hamming``: pairs in a bucket then have to pass the whole
chain, and only those get the full check.  ``similarity``: the key is two adjacent equal segments; no further chain is asked
for, which would lose pairs, and all pairs in a bucket whose groups are not linked yet go to the similarity itself.

How it scales: copies collapse to one fingerprint first, by partial aggregation.  A bucket gives a spanning forest of its
links, never its pairs.  Buckets above ``CAP`` (``CROWD`` for similarities) go another exact way: for Hamming distances up to 2
through the fingerprints one bit away, which two such neighbours share (65 rows a fingerprint, no pairs), beyond in blocks;
for similarities tight groups are linked through longer chains and pivots, and what then hangs apart is compared by bands of
sizes, in blocks.  Components come from :func:`common.connected_components`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, map_text, packed, unpacked

SEED = 42
CAP = 1_000  # fingerprints a bucket
CROWD = 4_000  # sketches a bucket: two megabytes
CELLS = 16
SKETCH = 512
# the estimate from a sketch has a standard error below 0.021 from 0.7 up; where it is within the margin the sets decide
MARGIN = 0.115
FEW, MARGIN_FEW = 64, 0.3  # in sets of few shingles two in one cell count for more
HELD = 4_000_000  # shingle hashes a bucket: 32 megabytes


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; fewer words give one shingle, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounds memory for very long texts
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _forest(n: int, near, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest.  ``near(i, rest)``: which of the positions ``rest`` are linked to i.  What already hangs
    together is not compared again, so a tight group costs little more than its size; equal labels hang together from the
    start."""
    label = np.arange(n) if label is None else label
    rest, out = np.arange(n), []
    while len(rest) > 1:
        own = label[rest] == label[rest[0]]
        queue, rest = rest[own].tolist(), rest[~own]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                _, first = np.unique(label[found], return_index=True)  # one edge joins all of a label
                out += [(i, int(j)) for j in found[first]]
                reached = np.isin(label[rest], label[found])
                queue += rest[reached].tolist()
                rest = rest[~reached]
    return out


def _each_bucket(rows: DataFrame, work, out: list[str]) -> DataFrame:
    """``work``: from a bucket's columns (name -> array) of ``rows(bucket, node, ...)`` to tuples of longs, columns ``out``.
    Buckets are bounded by the callers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(f: pd.DataFrame) -> pd.DataFrame:
            bucket, cols = f["bucket"].to_numpy(), {c: f[c].to_numpy() for c in f.columns}
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(f)]
            found = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high - low > 1:
                    found += work({c: x[low:high] for c, x in cols.items()})
            return pd.DataFrame(np.array(found, np.int64).reshape(-1, len(out)), columns=out)

        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            bucket = f["bucket"].to_numpy()
            last = int(np.argmax(bucket == bucket[-1]))
            if last:
                yield done(f.iloc[:last])
            held = f.iloc[last:]
        if held is not None:
            yield done(held)

    schema = ", ".join(f"{c} long" for c in out)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInPandas(run, schema)


def _links(rows: DataFrame, near, values: list[str]) -> DataFrame:
    """(a, b): spanning forests of the links inside each bucket of ``rows(bucket, node, label, *values)``; equal labels are
    linked already.

    ``near``: from a bucket's value arrays to the function that :func:`_forest` takes.
    """

    def work(f):
        node = f["node"]
        return [(node[x], node[y]) for x, y in _forest(len(node), near(*[f[v] for v in values]), f["label"])]

    return _each_bucket(rows, work, ["a", "b"])


def _sized(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``keys(bucket, node)`` of buckets with two nodes or more, and their size ``n``."""
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return scratch.table(keys.join(sizes, "bucket"), "sized")


# ---------------------------------------------------------------- Hamming distance of 64-bit fingerprints


def budgets(m: int, most: int) -> list[int]:
    """The most that the first l = 1..m segments of a chain may differ by."""
    return [(l * most) // m for l in range(1, m + 1)]


def _hamming_links(prints: DataFrame, most: int, scratch: Scratch, cap: int, segments: int = 8) -> DataFrame:
    """(a, b) between fingerprints of ``prints(node)``, distinct longs, at most ``most`` bits apart: enough of them to
    connect all that are."""
    width = 64 // segments
    allowed = budgets(segments, most)
    run = sum(b == 0 for b in allowed)  # opening segments that must be equal
    mask = (1 << (width * run)) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    turned = lambda c, k: c if not k else F.shiftleft(c, k).bitwiseOR(F.shiftrightunsigned(c, 64 - k))
    starts = [F.struct(F.lit(i).alias("start"), turned(F.col("node"), i * width).bitwiseAND(F.lit(signed(mask))).alias("chain")) for i in range(segments)]
    keys = prints.select("node", F.explode(F.array(*starts)).alias("k")).select(F.xxhash64("k.start", "k.chain").alias("bucket"), F.col("k.start").alias("start"), "node")
    sized = _sized(keys, scratch)
    parts = np.array([((1 << width) - 1) << (s * width) for s in range(segments)], np.uint64)

    def near(node: np.ndarray, start: np.ndarray):
        x = node.astype(np.int64).view(np.uint64)
        turn = int(start[0]) * width % 64
        x = (x << np.uint64(turn)) | (x >> np.uint64(64 - turn)) if turn else x

        def hit(i, rest):
            diff = x[rest] ^ x[i]
            total, ok = np.zeros(len(rest), np.int64), np.ones(len(rest), bool)
            for s in range(segments):  # the chain, then with all segments the full distance
                total += np.bitwise_count(diff & parts[s])
                ok &= total <= allowed[s]
            return ok

        return hit

    found = _links(sized.where(F.col("n") <= cap).select("bucket", "node", F.col("node").alias("label"), F.col("node").alias("value"), "start"), near, ["value", "start"])
    if most > 2:  # no such variants: crowded buckets are compared in blocks, every two of them a bucket of their own
        blocks = F.ceil(2 * F.col("n") / cap)
        dense = sized.where(F.col("n") > cap).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        dense = dense.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "node", F.col("node").alias("label"), F.col("node").alias("value"), "start")
        return found.union(_links(dense, near, ["value", "start"]))
    crowded = sized.where(F.col("n") > cap).select("node").distinct()
    if most < 2:  # fingerprints one bit apart: one is a variant of the other
        flips = [F.col("node").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)] if most else []
        other = crowded.select("node", F.explode(F.array(F.col("node"), *flips)).alias("at"))
        return found.union(other.join(crowded.withColumnRenamed("node", "at"), "at").where("at > node").select("node", "at"))
    flips = [F.col("node").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)]
    around = crowded.select("node", F.explode(F.array(F.col("node"), *flips)).alias("at"))
    least = around.groupBy("at").agg(F.min("node").alias("m"), F.count("*").alias("n")).where("n > 1")
    return found.union(around.join(least, "at").where("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct())


def hamming_classes(docs: DataFrame, width: int = 3, most: int = 2, cap: int = CAP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows with equal doc_ids stay rows of their
    own; a null doc_id is never the least unless its class has no other, and then component_id is null.  Other columns
    are not read.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")

    def prints():
        return lambda texts: [np.array([fingerprint(shingles(t, width)) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.table(map_text(rows, prints, "node long"), "prints")
    nodes = scratch.table(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    classes = connected_components(_hamming_links(nodes.select("node"), most, scratch, cap), scratch)
    nodes = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    # written, so that the join below can split the rows of a fingerprint that very many documents share
    named = scratch.table(nodes.select("node", "component").join(named, "component").select("node", "component_id"), "named")
    return rows.join(named, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of shingle sets


def cells(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least hash of each of n cells, 0 where a cell is empty: one-shingle samples that equal sets share."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        h = np.sort(hashes)[::-1]
        out[(h % np.uint64(n)).astype(np.int64)] = h | np.uint64(1)  # the last assignment, the least hash, stays
    return out


def ring(hashes: np.ndarray) -> np.ndarray:
    """The segments of a set of shingles; an empty cell takes the next full one's sample, marked with the distance, so
    that short texts do not meet in their empty cells."""
    out = cells(hashes, CELLS)
    full = np.flatnonzero(out)
    if 0 < len(full) < CELLS:
        for i in np.flatnonzero(out == 0).tolist():
            step = int(((full - i) % CELLS).min())
            out[i] = out[(i + step) % CELLS] ^ np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
    return out


def _sketches(width: int):
    def start():
        def run(texts):
            digest, segs, sketch, size = [], [], [], []
            for t in texts:
                h = np.unique(shingles(t, width))
                digest.append(xxhash.xxh128_digest(h.tobytes()))
                # other bits than the cell's number stand in the sketch
                segs.append(ring(h).view(np.int64).tolist())
                size.append(len(h))
                fine = cells(h, SKETCH)
                short = ((fine >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
                short[fine == 0] = 0
                sketch.append(short.tobytes())
            return [digest, segs, sketch, size]

        return run

    return start


def estimate(sketches: np.ndarray):
    """``of(i, rest)``: (estimated Jaccard similarity of row i with rows ``rest``, its margin)."""
    used = sketches > 0
    n = used.sum(1)

    def of(i, rest):
        both = used[rest] & used[i]
        held = both.sum(1)
        same = ((sketches[rest] == sketches[i]) & both).sum(1)
        chance = (held - same) / 254  # equal short hashes of different shingles
        union = n[rest] + n[i] - held
        return np.where(union > 0, (same - chance) / np.maximum(union, 1), 1.0), np.where(union < FEW, MARGIN_FEW, MARGIN)

    return of


def similar(sketches: np.ndarray, sets: np.ndarray | None, least: float):
    """``hit(i, rest)``: which rows ``rest`` have a Jaccard similarity of at least ``least`` with row i.

    sets: sorted shingle hashes of each row as bytes; they decide where the estimate does not.  Without them only what the
    estimate is sure of is a hit."""
    of = estimate(sketches)

    def hit(i, rest):
        about, margin = of(i, rest)
        out = about >= least + margin
        if sets is not None:
            open_ = np.flatnonzero(~out & (about >= least - margin))
            if len(open_):
                out[open_] = jaccard(sets[i], sets[rest[open_]], least)
        return out

    return hit


def jaccard(one: bytes, others: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity of the sets is at least ``least``, exactly; sets as in :func:`similar`, none empty."""
    own, every = np.frombuffer(one, np.uint64), np.frombuffer(b"".join(others), np.uint64)
    sizes = np.array([len(o) // 8 for o in others])
    found = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= least * (len(own) + sizes - both) - 1e-9


def _chain_keys(columns: DataFrame, patterns: list[tuple[int, ...]]) -> DataFrame:
    """(bucket, node): a key for each start on the ring and each pattern of segments that must be equal."""
    chosen = F.array(*[F.array(*map(F.lit, p)) for p in patterns])
    segment = lambda i, s: F.element_at("segs", (i + s) % CELLS + 1)
    key = lambda i, p: F.xxhash64(i, p, F.transform(p, lambda s: segment(i, s)))
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.transform(chosen, lambda p: key(i, p))))
    return columns.select("node", "size", F.posexplode(keys).alias("at", "bucket")).select("node", "size", "bucket", F.expr(f"cast(at div {len(patterns)} as int)").alias("start"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the sorted shingle hashes of the nodes ``wanted(node, doc_id, tie)``."""

    def start():
        return lambda texts: [[np.unique(shingles(t, width)).tobytes() for t in texts]]

    wanted = wanted.select("node", F.col("doc_id").alias("want_id"), F.col("tie").alias("want_tie"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("tie") == F.col("want_tie"))).select("node", "text")
    return map_text(rows, start, "hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _open(told: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(bucket, node, label) of the nodes of ``told(bucket, start, node, label)`` that may be similar to one of another label.

    A pair counts only in the bucket of the first start that it shares."""

    def work(f):
        label, start = f["label"], int(f["start"][0])
        segs = np.stack(f["segs"])
        of = estimate(_stacked(f["sketch"]))
        names, size = np.unique(label, return_counts=True)
        marked = np.zeros(len(label), bool)
        for i in np.flatnonzero(label != names[size.argmax()]).tolist():
            rest = np.flatnonzero(label != label[i])
            equal = segs[rest] == segs[i]
            rest = rest[(equal & np.roll(equal, -1, 1)).argmax(1) == start]
            about, margin = of(i, rest)
            rest = rest[about >= least - margin]
            if len(rest):
                marked[i] = marked[rest] = True
        return [(f["bucket"][k], f["node"][k], label[k]) for k in np.flatnonzero(marked)]

    return _each_bucket(told.join(nodes.select("node", "segs", "sketch"), "node"), work, ["bucket", "node", "label"])


def _parted(told: DataFrame, cap: int, least: float) -> DataFrame:
    """(bucket, start, node, label) of the buckets of ``told(bucket, start, n, node, size, label)`` in which labels meet; those above
    ``cap`` in parts.

    Sets of a similarity of ``least`` have sizes within that ratio, so a crowded bucket falls into bands of sizes, each row in
    its own and the next one.  Bands that still are crowded go in blocks: a band's largest label has blocks of its own, which
    need not meet each other, so with few others beside a large group the rows grow with its size and not with its square."""
    names = ["bucket", "start", "node", "label"]
    rows = _mixed(told)
    small = rows.where(F.col("n") <= cap).select(names)
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(1 / (least * (1 - 1e-6))))
    rows = rows.where(F.col("n") > cap).withColumn("band", F.explode(F.array(band, band + 1))).withColumn("bucket", F.xxhash64("bucket", "band"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = _mixed(rows.select(*names).join(sizes, "bucket"))
    main, n_main, n_rest = F.col("label") == F.col("main"), F.ceil(2 * F.col("n_main") / cap), F.ceil(2 * (F.col("n") - F.col("n_main")) / cap)
    deal = lambda n: F.pmod(F.xxhash64("node", "bucket"), n)
    dense = rows.where(F.col("n") > cap).withColumn("block", F.when(main, deal(n_main)).otherwise(n_main + deal(n_rest)))
    dense = dense.withColumn("other", F.explode(F.sequence(F.when(main, n_main).otherwise(F.lit(0).cast("long")), n_main + n_rest - 1)))
    dense = dense.withColumn("bucket", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    return small.union(rows.where(F.col("n") <= cap).select(names)).union(dense.select(names))


def _mixed(told: DataFrame) -> DataFrame:
    """``told(bucket, label, ...)`` of the buckets with two labels or more, with the largest (``main``, ``n_main`` rows)."""
    labels = told.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket")
    labels = labels.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("n_main"), F.count("*").alias("labels")).where("labels > 1")
    return told.join(labels, "bucket")


def _within(asked: DataFrame) -> DataFrame:
    """``asked(bucket, node, label, size, sketch)`` with buckets of more than ``HELD`` shingles in blocks, each two a bucket."""
    sizes = asked.groupBy("bucket").agg(F.sum("size").alias("all"))
    rows = asked.join(sizes, "bucket").withColumn("blocks", F.when(F.col("all") <= HELD, 1).otherwise(F.ceil(2 * F.col("all") / HELD)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "node", "label", "sketch")


def _stacked(sketch: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), SKETCH)


def similarity_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, cap: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, tie (xxhash64 of the text), component (long), copies (rows) and first (boolean) for each distinct doc_id and text.

    Classes are connected components of pairs whose sets of word shingles have a Jaccard similarity of at least
    ``similarity``.  512 one-shingle samples decide where their estimate is over five standard errors away from it, the
    sets themselves elsewhere.  Pairs are looked for where two adjacent segments of 16 are equal: of pairs at 0.8, all but
    about 2 in 100,000 have such a start (by the binomial).  ``first`` marks the row of least doc_id (nulls last, ties by ``tie``) of each
    class.  Documents without words form one class.  Other columns are not read.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    sketches = scratch.table(map_text(rows, _sketches(width), "digest binary, segs array<long>, sketch binary, size long"), "sketches")
    # copies first: one node for a set of shingles
    rows = sketches.withColumn("node", F.xxhash64("digest"))
    nodes = scratch.table(rows.groupBy("node").agg(F.first("segs").alias("segs"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first(F.struct("doc_id", "tie")).alias("from")), "nodes")
    short = [tuple(range(sum(b == 0 for b in budgets(CELLS, 7))))]  # the first two segments
    sized = _sized(_chain_keys(nodes, short), scratch)
    few = sized.where(F.col("n") <= cap).select("bucket", "node")
    crowd = nodes.join(sized.where(F.col("n") > cap).select("node").distinct(), "node", "left_semi")
    # of a chain's first 4, 6 and 8 segments at most 1, 2 and 3 differ: five of the eight are equal, in one of 14 ways
    more = _sized(_chain_keys(crowd, [(0, 1, *rest) for rest in _triples()]), scratch)
    few = few.union(more.where(F.col("n") <= cap).select("bucket", "node"))
    # what is still crowded is dealt into blocks, and the first block of each bucket meets all of them: a tight group is linked
    # through it by rows in proportion to its size.  What then hangs apart is left to the sets below, which lose nothing
    blocks = F.ceil(2 * F.col("n") / cap).cast("int")
    dense = more.where(F.col("n") > cap).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int"))
    dense = dense.withColumn("other", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("block"))))
    dense = dense.select(F.xxhash64("bucket", "other").alias("bucket"), "node")
    work = scratch.table(few.union(dense), "work")

    def near(sketch, sets=None):
        return similar(_stacked(sketch), sets, similarity)

    # first an eighth of the buckets; then all, where more than one class meets and only between classes: a large tight
    # group is linked once and not in every bucket that it fills
    sketch, some = nodes.select("node", "sketch"), F.pmod("bucket", F.lit(8)) == 0
    early = scratch.table(_links(work.where(some).withColumn("label", F.col("node")).join(sketch, "node"), near, ["sketch"]), "early")
    told = work.join(connected_components(early, scratch), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    told = scratch.table(told, "told")
    open_ = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    late = _links(told.join(open_, "bucket", "left_semi").join(sketch, "node"), near, ["sketch"])
    sure = scratch.table(early.union(late), "sure")
    classes = connected_components(sure, scratch)
    # what the estimate leaves open, in the first buckets again: the sets decide
    told_all = scratch.table(sized.join(classes, "node", "left").select("bucket", "start", "n", "node", "size", F.coalesce("component", "node").alias("label")), "told")
    asked = scratch.table(_open(_parted(told_all, cap, similarity), nodes, similarity), "asked")
    known = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "from.doc_id", "from.tie")
    sets = scratch.table(_sets(docs, known, width), "sets")
    exact = scratch.table(_links(_within(asked.join(nodes.select("node", "size", "sketch"), "node")).join(sets, "node"), near, ["sketch", "hashes"]), "exact")
    classes = connected_components(sure.union(exact), scratch)
    seen = rows.groupBy("doc_id", "tie").agg(F.first("node").alias("node"), F.count("*").alias("copies"))
    seen = seen.join(classes, "node", "left").select("doc_id", "tie", "copies", F.coalesce("component", "node").alias("component"))
    seen = scratch.table(seen, "seen")
    scratch.drop(sized, more, work, told, told_all, asked, sets, early, sure, exact, nodes, sketches)
    # the row to keep by partial aggregation: a class may hold a third of all rows
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tie"))
    least = scratch.table(seen.groupBy("component").agg(F.min(key).alias("keep")), "least")
    return seen.join(least, "component").select("doc_id", "tie", "component", "copies", key.eqNullSafe(F.col("keep")).alias("first"))


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, cap: int = CROWD) -> DataFrame:
    """The rows of ``docs`` that stay when each class of :func:`similarity_classes` keeps one document, with all columns
    of ``docs`` whatever their names.  Of rows equal in doc_id and text one stays (any of them).  Nulls, empty texts and an
    empty table as there.

    Whole rows move once, to meet the keys that stay; only those of keys with several rows move again."""
    first = similarity_classes(docs, width, similarity, cap).where("first").select(F.col("doc_id").alias("keep_id"), F.col("tie").alias("keep_tie"), "copies")
    rows = packed(docs, "doc_id", "text").withColumn("in_tie", F.xxhash64("in_text")).drop("in_text")
    rows = rows.join(first, F.col("in_doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("in_tie") == F.col("keep_tie")))
    several = rows.where("copies > 1").groupBy("keep_id", "keep_tie").agg(F.first("row").alias("row"))
    return unpacked(rows.where("copies = 1").select("row").union(several.select("row")))


def _triples() -> list[tuple[int, ...]]:
    from itertools import combinations

    allowed = budgets(CELLS, 7)
    found = []
    for t in combinations(range(2, 8), 3):
        equal = {0, 1, *t}
        if all(l - len([s for s in equal if s < l]) <= allowed[l - 1] for l in range(1, 9)):
            found.append(t)
    return found

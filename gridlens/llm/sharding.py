"""Shards of nearly equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

How it scales: rows are summed to one number for each distinct text before anything else, so a text that a third of all
rows repeat is one number.  The numbers are dealt by hash into buckets of about ``BUCKET`` groups; each bucket is
differenced in its own task into one partial partition (``shards`` sums).  Partial partitions are differenced again,
``FAN`` at a time, until at most ``FAN`` are left, which the driver combines: it sees ``FAN * shards`` numbers whatever
the input.  Every combination is a Karmarkar-Karp step: the two partial partitions of largest spread are added in
opposite order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKET = 20_000
FAN = 256
ROW_OVERHEAD = 16


def difference(parts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions; returns (set of each node, sums of the k sets, largest first).

    ``parts``: ints (one indivisible group each, node i is group i), or arrays of k sums (node i * k + j is set j of
    part i).  Ties go by position.  No parts give k sets of sum 0.
    """
    if not parts:
        return np.empty(0, np.int64), np.zeros(k, np.int64)
    single = not isinstance(parts[0], np.ndarray)
    n = len(parts) if single else len(parts) * k
    follow = np.full(n, -1, np.int64)  # next node of the same set

    def grown(i):
        sums, heads = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        if single:
            sums[0], heads[0] = parts[i], i
            return sums, heads, heads.copy()
        order = np.argsort(-parts[i], kind="stable")
        heads = i * k + order
        return parts[i][order], heads, heads.copy()

    heap = [(-int(p if k > 1 else 0) if single else int(p.min() - p.max()), i, None) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, i, x = heapq.heappop(heap)
        a_sums, a_heads, a_tails = x or grown(i)
        _, j, y = heap[0]
        b_sums, b_heads, b_tails = y or grown(j)
        b_sums, b_heads, b_tails = b_sums[::-1], b_heads[::-1], b_tails[::-1]
        both = (a_heads >= 0) & (b_heads >= 0)
        follow[a_tails[both]] = b_heads[both]
        sums = a_sums + b_sums
        heads = np.where(a_heads >= 0, a_heads, b_heads)
        tails = np.where(b_heads >= 0, b_tails, a_tails)
        order = np.argsort(-sums, kind="stable")
        sums, heads, tails = sums[order], heads[order], tails[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), count, (sums, heads, tails)))
        count += 1
    _, i, x = heap[0]
    sums, heads, _ = x or grown(i)
    sets = np.empty(n, np.int64)
    for s, node in enumerate(heads.tolist()):
        while node >= 0:
            sets[node] = s
            node = int(follow[node])
    return sets, sums


def _per_key(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key, from rows sorted by key; one key is held at a time."""
    held: list[pd.DataFrame] = []
    for f in frames:
        while len(f):
            same = f[key].to_numpy() == f[key].iat[0]
            cut = len(f) if same.all() else int(np.argmin(same))
            if held and held[0][key].iat[0] != f[key].iat[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(f.iloc[:cut])
            f = f.iloc[cut:]
    if held:
        yield pd.concat(held, ignore_index=True)


def balanced_shards(docs: DataFrame, shards: int = 40, bucket: int = BUCKET, fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs(doc_id, text)``; other columns are not read.

    Equal texts share a shard; a null text has size 16 and crc 0 and goes with the empty texts.  Null and repeated
    doc_ids keep all their rows.  Slots run from 0 without gaps in each shard; rows equal in doc_id and text take theirs
    in any order among themselves.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    rows = scratch.table(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
        ),
        "rows",
    )
    n_rows = rows.count()
    n_buckets = max(1, -(-n_rows // bucket))  # rows bound the groups from above
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)))

    def split(frames):
        for g in _per_key(frames, "part"):
            g = g.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable", ignore_index=True)
            sets, _ = difference(g["bytes"].tolist(), shards)
            yield pd.DataFrame({"digest": g["digest"], "part": g["part"], "set": sets, "bytes": g["bytes"]})

    placed = scratch.table(
        groups.repartition("part").sortWithinPartitions("part").mapInPandas(split, "digest binary, part long, set long, bytes long"),
        "placed",
    )
    sums = placed.groupBy("part", "set").agg(F.sum("bytes").alias("bytes"))
    to_shard = _combined(sums, n_buckets, shards, fan, scratch)
    placed = placed.select("digest", "part", "set").join(to_shard, ["part", "set"]).select("digest", "shard")
    # slots: counts of (chunk, shard) give each chunk its first slot in every shard, so no shard meets in one task
    n_chunks = max(1, -(-n_rows // 50_000))
    at = rows.join(placed, "digest").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_chunks)))
    at = scratch.table(at, "at")
    first = at.groupBy("chunk", "shard").agg(F.count("*").alias("n")).withColumn(
        "first", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    )
    here = F.row_number().over(Window.partitionBy("chunk", "shard").orderBy("doc_id", "digest"))
    out = at.withColumn("here", here).join(first.select("chunk", "shard", "first"), ["chunk", "shard"])
    scratch.drop(rows)
    return out.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.coalesce(F.col("first"), F.lit(0)) + F.col("here") - 1).cast("long").alias("slot"),
    )


def _combined(sums: DataFrame, n_parts: int, k: int, fan: int, scratch: Scratch) -> DataFrame:
    """(part, set, shard): partial partitions differenced ``fan`` at a time, the last of them on the driver."""
    spark = sums.sparkSession
    if n_parts <= fan:
        table: dict[int, np.ndarray] = {}
        for r in sums.collect():  # at most fan * k numbers
            table.setdefault(r.part, np.zeros(k, np.int64))[r.set] = r.bytes
        parts = sorted(table)
        sets, _ = difference([table[p] for p in parts], k)
        rows = [(p, j, int(sets[i * k + j])) for i, p in enumerate(parts) for j in range(k)]
        return F.broadcast(spark.createDataFrame(rows, "part long, set long, shard long"))  # at most fan * k rows

    def merge(frames):
        for g in _per_key(frames, "up"):
            ids = np.sort(g["part"].unique())
            table = np.zeros((len(ids), k), np.int64)
            table[np.searchsorted(ids, g["part"]), g["set"]] = g["bytes"]
            sets, _ = difference(list(table), k)
            yield pd.DataFrame({"part": np.repeat(ids, k), "set": np.tile(np.arange(k), len(ids)), "up": g["up"].iat[0], "up_set": sets, "bytes": table.ravel()})

    level = sums.withColumn("up", F.floor(F.col("part") / fan)).repartition("up").sortWithinPartitions("up")
    level = scratch.table(level.mapInPandas(merge, "part long, set long, up long, up_set long, bytes long"), "level")
    above = level.groupBy(F.col("up").alias("part"), F.col("up_set").alias("set")).agg(F.sum("bytes").alias("bytes"))
    above = _combined(above, -(-n_parts // fan), k, fan, scratch).toDF("up", "up_set", "shard")
    return level.join(above, ["up", "up_set"]).select("part", "set", "shard")

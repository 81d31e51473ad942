"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned onto principal axes (a rotation: distances stay), laid on a grid of cell width epsilon in the
leading axes and sorted by label and cell.  The sequence is cut into blocks of ``BLOCK`` vectors with bounding boxes.  The
join starts from whole sequences and splits them level by level: a pair of intervals whose boxes are farther apart than
epsilon is dropped, the others split ``FAN``-fold, down to blocks, whose vectors are compared.

How it scales: equal vectors collapse to one with a weight first.  A task takes a block and streams the blocks that it may meet
past it, in the width that the input has.  Block pairs give link counts and spanning forests, not pairs of vectors, so a
large group of copies adds no rows.  Vectors of each length are a join of their own, one after another.  The rotation is fitted on ``SAMPLE`` vectors; it serves
pruning alone, results do not depend on it.  A window goes over the tasks that made a label's blocks, never over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, small_batches

BLOCK = 512
FAN = 8
GRID_DIMS = 6
BOX_DIMS = 16
SAMPLE = 4096


def _rotation(sample: list, dims: int) -> np.ndarray:
    x = np.array([v for v in sample if len(v) == dims], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.svd(x - x.mean(0), full_matrices=True)[2].T


def _unit(raw: np.ndarray) -> np.ndarray:
    scale = np.abs(raw).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    raw = raw / scale
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def linked_vectors(vectors: DataFrame, least: float = 0.93, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Rows are linked when their labels are equal and not null and the cosine of their embeddings, in double precision, is
    at least ``least``.  Null and zero embeddings, embeddings with null or non-finite components, rows with a null label
    and embeddings of different lengths link with nothing (component_id = vec_id).  Rows with equal vec_ids are rows of
    their own; a null vec_id is the least of a class only if it has no other.  kept: vec_id = component_id.  Other columns
    are not read.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    kind = vectors.schema["embedding"].dataType
    width = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"  # as exact as the input
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are one component
    rows = rows.withColumn("fine", fine).withColumn("embedding", F.when(F.col("fine"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    node = F.xxhash64("label", "embedding", F.lit(1)), F.xxhash64(F.lit(2), "embedding", "label")
    rows = rows.withColumn("key", F.when(F.col("fine"), F.struct(node[0].alias("x"), node[1].alias("y"))))
    rows = scratch.table(rows, "rows")
    good = rows.where("fine")
    reps = good.groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = scratch.table(reps.withColumn("dims", F.size("embedding")).withColumn("node", F.col("key.x")), "reps")
    links = []
    for dims in [r.dims for r in reps.select("dims").distinct().collect()]:
        part = reps.where(F.col("dims") == dims)
        links.append(_join(part, dims, least, block, width, scratch))
    if links:
        found = links[0]
        for x in links[1:]:
            found = found.union(x)
        found = scratch.table(found, "links")
    else:
        found = spark.createDataFrame([], "a long, b long, links long")
    classes = connected_components(found.where("b is not null").select("a", "b"), scratch)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = reps.select("key", "node", "weight", "least").join(classes, "node", "left").join(counts, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", "key").join(scratch.table(nodes, "named"), "key").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _join(reps: DataFrame, dims: int, least: float, block: int, width: str, scratch: Scratch) -> DataFrame:
    """(a, null, links): weighted links of a node; (a, b, null): edges that connect what is linked."""
    sample = reps.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()
    turn = _rotation([r.embedding for r in sample], dims)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    grid, box = min(GRID_DIMS, dims), min(BOX_DIMS, dims)

    def place(frames):
        for f in frames:
            y = _unit(np.stack(f["embedding"].to_numpy())) @ turn[:, :grid]
            yield f.assign(cell=list(np.floor(y / eps).astype(np.int64)))

    at = reps.select("label", "node", "weight", "embedding").mapInPandas(place, "label string, node long, weight long, embedding array<double>, cell array<long>")
    n = reps.count()
    order = ["label", "cell", "node"]
    at = at.repartitionByRange(max(1, -(-n // (8 * block))), *order).sortWithinPartitions(*order)

    def blocks(frames):
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def closed(f):
            raw = np.stack(f["embedding"].to_numpy())
            y = _unit(raw) @ turn[:, :box]
            return (task << 32 | number, f["label"].iat[0], f["node"].to_numpy(np.int64).tobytes(), f["weight"].to_numpy(np.int64).tobytes(), raw.astype(width).tobytes(), y.min(0).tolist(), y.max(0).tolist())

        names = ["block", "label", "nodes", "weights", "vectors", "low", "high"]
        for f in frames:
            held = f if not len(held) else pd.concat([held, f], ignore_index=True)
            out = []
            while len(held):
                same = held["label"].to_numpy() == held["label"].iat[0]
                run = len(held) if same.all() else int(np.argmin(same))
                if run < block and run == len(held):
                    break
                cut = min(run, block)
                out.append(closed(held.iloc[:cut]))
                number, held = number + 1, held.iloc[cut:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out, columns=names)
        if len(held):
            yield pd.DataFrame([closed(held)], columns=names)

    made = scratch.table(at.mapInPandas(blocks, "block long, label string, nodes binary, weights binary, vectors binary, low array<double>, high array<double>"), "blocks")
    # a block's place in its label's sequence: the blocks of the tasks before, then those before it in its task
    task = F.shiftright("block", 32).alias("task")
    sums = made.groupBy("label", task).agg(F.count("*").alias("n"), F.min("block").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("label", "task", (ahead - F.col("first")).alias("start"))
    boxes = made.select("block", "label", "low", "high", task).join(starts, ["label", "task"])
    boxes = scratch.table(boxes.select("block", "label", "low", "high", (F.col("start") + F.col("block")).alias("place")), "boxes")
    most = boxes.agg(F.max("place")).first()[0] or 0
    levels = [boxes.select("label", F.col("place").cast("long").alias("place"), "low", "high")]
    while most > 0:
        most //= FAN
        lows = [F.min(F.col("low")[i]) for i in range(box)]
        highs = [F.max(F.col("high")[i]) for i in range(box)]
        up = levels[-1].groupBy("label", F.floor(F.col("place") / FAN).alias("place")).agg(F.array(*lows).alias("low"), F.array(*highs).alias("high"))
        levels.append(scratch.table(up, "level"))
    apart = F.aggregate(  # squared distance of two boxes
        F.sequence(F.lit(0), F.lit(box - 1)), F.lit(0.0),
        lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i]), F.lit(2)),
    )
    top = levels[-1].select("label", "place")
    pairs = top.select("label", F.col("place").alias("a"), F.col("place").alias("b"))
    for level in reversed(levels[:-1]):
        child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        pairs = pairs.withColumn("a", child("a")).withColumn("b", child("b")).where("a <= b")
        for side in "ab":
            pairs = pairs.join(level.select("label", F.col("place").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), ["label", side])
        pairs = scratch.table(pairs.where(apart <= eps * eps).select("label", "a", "b"), "pairs")
    ids = boxes.select("label", "place", "block")
    pairs = pairs.join(ids.withColumnsRenamed({"place": "a", "block": "block_a"}), ["label", "a"]).join(ids.withColumnsRenamed({"place": "b", "block": "block_b"}), ["label", "b"])
    # every block meets itself; a row of its own carries it, the others stream past it
    body, what = made.select("block", "nodes", "weights", "vectors"), ["block_a", "block_b", "nodes", "weights", "vectors"]
    own = body.select(F.col("block").alias("block_a"), F.lit(None).cast("long").alias("block_b"), "nodes", "weights", "vectors")
    other = pairs.where("block_a <> block_b").join(body.withColumnRenamed("block", "block_b"), "block_b").select(*what)
    stream = own.union(other).repartition("block_a").sortWithinPartitions(F.col("block_a"), F.col("block_b").asc_nulls_first())
    small_batches(reps.sparkSession)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            for r in f.itertuples(index=False):
                now = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.weights, np.int64), _unit(np.frombuffer(r.vectors, width).reshape(-1, dims).astype(np.float64))
                if pd.isna(r.block_b):
                    held = now
                yield _pairs(held, now, least)

    return stream.mapInPandas(compare, "a long, b long, links long")


def _pairs(left: tuple, right: tuple, least: float) -> pd.DataFrame:
    """Links of two blocks (nodes, weights, unit vectors), or of one with itself."""
    (na, wa, a), (nb, wb, b) = left, right
    near = a @ b.T >= least
    if left is right:
        np.fill_diagonal(near, False)
        counts = [(na, near @ wa)]
    else:
        counts = [(na, near @ wb), (nb, wa @ near)]
    x, y = _forest(near)
    out = [pd.DataFrame({"a": n[c > 0], "b": pd.array([None] * int((c > 0).sum()), "Int64"), "links": c[c > 0]}) for n, c in counts]
    out.append(pd.DataFrame({"a": na[x], "b": pd.array(nb[y], "Int64"), "links": pd.array([None] * len(x), "Int64")}))
    return pd.concat(out, ignore_index=True).astype({"b": "Int64", "links": "Int64"})


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of enough links to connect all that the matrix connects: at most rows + columns of them."""
    free_a, free_b = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    x, y = [], []
    for start in np.flatnonzero(near.any(1)).tolist():
        if not free_a[start]:
            continue
        free_a[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(near[i] & free_b).tolist():
                free_b[j] = False
                x.append(i)
                y.append(j)
                more = np.flatnonzero(near[:, j] & free_a)
                free_a[more] = False
                x += more.tolist()
                y += [j] * len(more)
                queue += more.tolist()
    return np.array(x, np.int64), np.array(y, np.int64)

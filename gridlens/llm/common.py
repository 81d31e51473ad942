"""Shared helpers: scratch tables in the cluster's shared folder, text access, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folder: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local temporary one only where that is unset and all executors are on
    this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="gridlens-")
    return _own_folder[app]


class Scratch:
    """Tables that one run writes to the shared folder and reads back.

    Written tables cut the lineage: a lost executor costs the tasks of the running stage, not the stages before it.
    ``drop`` removes a table that nothing will read again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"

    def uri(self, where: str) -> str:
        """A path with its scheme, as libraries outside Spark take it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        full = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full

    def table(self, df: DataFrame, label: str) -> DataFrame:
        where = self.path(label)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._scratch_path)

    def delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns under names of our own and the whole row as struct ``row``: no column of the caller can clash.

    A needed column that the table lacks is null.
    """
    have = {c.lower(): c for c in df.columns}
    cols = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")]
    cols += [(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(f"in_{c}") for c in needed]
    return df.select(*cols)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node long, component long: smallest node reachable) for every node of ``edges(a long, b long)``.

    Alternating large-star and small-star (Kiveris et al. 2014) with minima and equi-joins only: no adjacency list is
    ever gathered, and the minima are written first, so that a hub's edges can be split over tasks in each join.  Each round is written to the shared folder.  Null ends and
    self loops are ignored; repeated edges count once; an empty table gives an empty table.
    """
    now = scratch.table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while True:  # each round that changes the edges brings them nearer to stars; the squared logarithm of the nodes bounds them
        # large star: every larger neighbour of u, and u, point to the least node around u
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large")
        # small star: every smaller neighbour of u, and u, point to the least of them
        lower = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.table(small.union(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        same = _digest(after) == _digest(now)
        scratch.drop(least, lower, large, now)
        now = after
        if same:
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("g"),
    ).first()
    return r.n, r.h, r.g


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's own default: too much at once for a small executor."""
    small = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(small) == "67108864b":
        spark.conf.set(small, "8m")


def map_text(df: DataFrame, start: Callable, added: str, chars: int = 2_000_000, inside: str | None = None, arrow_texts: bool = False, given: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with column ``text`` replaced by the columns of the DDL ``added``.

    given: columns that the function gets as Arrow arrays besides.  inside: the text is the field of that name of column ``row`` instead, and ``row`` stays (see :func:`packed`).

    ``start()`` runs once a task and gives a function from a list of texts to a list of columns (lists or arrays).  It
    sees about ``chars`` bytes at a time (as an Arrow array, if so asked), so memory follows the longest text and not the batch.  Other columns pass
    through as Arrow arrays, nulls and all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    field = None if inside is None else [f.name.lower() for f in df.schema["row"].dataType.fields].index(inside)
    keep = [f for f in df.schema.fields if f.name != "text"]
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*keep, *new.fields])
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)
    names, types = [f.name for f in keep], [f.type for f in to_arrow_schema(new)]

    def run(batches):
        work = start()
        for b in batches:
            texts = b.column("text") if field is None else pc.struct_field(b.column("row"), [field])
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            low = 0
            while low < len(texts):
                done = sizes[low - 1] if low else 0
                high = max(low + 1, int(sizes.searchsorted(done + chars, side="right")))
                part = texts.slice(low, high - low)
                got = work(part if arrow_texts else part.to_pylist(), *[b.column(n).slice(low, high - low) for n in given])
                cols = [b.column(n).slice(low, high - low) for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(n).type) for c, n in zip(cols, names, strict=True)] + [pa.array(g, t) for g, t in zip(got, types, strict=True)], schema=arrow)
                low = high

    return df.mapInArrow(run, schema)

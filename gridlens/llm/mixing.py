"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

Budgets go down the tree by weight.  A node can use no more than ``max_epochs`` times the tokens below it; what a node
cannot use goes to its siblings by their weights, and only what all of them cannot use is missing one level up, where it
goes to the ancestor's siblings.  A leaf takes whole epochs and, of the next, the prefix of a seeded order that fits.

How it scales: DataFrame functions only.  Documents are read for two aggregations and one filter, never sorted as a
whole: each epoch's order is that of a hash, whose leading bits make ``buckets``; sums over (leaf, bucket) show in which
bucket a leaf's prefix ends, and only that bucket's rows, about ``per_bucket`` at most, are ordered.  A leaf with a third of
all rows is spread over all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, packed

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source: by the last digit of its name; sources without one are ``other``."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(digit.isin("0", "1", "2", "3"), F.lit("web")).when(digit.isin("4", "5", "6"), F.lit("books")).when(digit.isin("7", "8", "9"), F.lit("forum")).otherwise(F.lit("other"))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up; null and empty texts have none."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: int, max_epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves(*levels, tokens)`` with each leaf's ``budget``.

    weights: by level, the integer weight of a value among its siblings (``*``: of values not named; 1 if not given).
    Shares are integers: at most one token a node is lost to rounding.  Water-filling in closed form: siblings in order of
    capacity by weight are full as long as their capacity is at most their share of what the fuller ones leave.
    """
    exact = "decimal(38,0)"
    nodes = leaves.select(*levels, (F.col("tokens") * max_epochs).cast(exact).alias("room"))
    by_depth = [nodes]  # capacities from the leaves up; by_depth[0]: the first level
    for depth in range(len(levels) - 1, 0, -1):
        by_depth.insert(0, by_depth[0].groupBy(*levels[:depth]).agg(F.sum("room").cast(exact).alias("room")))
    top = nodes.agg(F.sum("room").alias("all")).select(F.least(F.coalesce("all", F.lit(0).cast(exact)), F.lit(total).cast(exact)).alias("up"))
    filled = None
    for depth, here in enumerate(by_depth):
        level, parents = levels[depth], list(levels[:depth])
        own = weights.get(level, {})
        w = reduce(lambda c, kv: F.when(F.col(level) == kv[0], F.lit(kv[1])).otherwise(c), ((k, v) for k, v in own.items() if k != "*"), F.lit(own.get("*", 1))).cast(exact)
        here = here.withColumn("w", w)
        if filled is None:
            here = here.crossJoin(F.broadcast(top))  # one row
        else:
            keys = [F.col(p).eqNullSafe(F.col(f"up_{p}")) for p in parents]
            above = filled.select(*[F.col(p).alias(f"up_{p}") for p in parents], F.col("budget").alias("up"))
            here = here.join(above, reduce(lambda a, b: a & b, keys)).drop(*[f"up_{p}" for p in parents])
        # nodes of weight 0 get nothing; the rest in order of room / w, ties by name
        order = Window.partitionBy(*parents).orderBy((F.col("room").cast("double") / F.col("w").cast("double")).asc_nulls_last(), F.col(level).asc_nulls_first())
        here = here.where("w > 0") if 0 in own.values() else here
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(0, Window.unboundedFollowing)
        here = here.withColumns({"used": F.coalesce(F.sum("room").over(before), F.lit(0)).cast(exact), "rest_w": F.sum("w").over(after).cast(exact)})
        full = F.col("room").cast("double") * F.col("rest_w").cast("double") <= (F.col("up") - F.col("used")).cast("double") * F.col("w").cast("double")
        here = here.withColumn("full", full)
        # the first that is not full fixes the share of all that follow
        stop = Window.partitionBy(*parents)
        here = here.withColumns({
            "left": F.max(F.when(~F.col("full"), F.col("up") - F.col("used"))).over(stop),
            "share_w": F.max(F.when(~F.col("full"), F.col("rest_w"))).over(stop),
        })
        share = F.expr("(left * w) div share_w").cast(exact)
        filled = here.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(share)).select(*levels[: depth + 1], "budget")
    keys = [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in levels]
    found = filled.select(*[F.col(c).alias(f"leaf_{c}") for c in levels], F.col("budget").cast("long").alias("budget"))
    return leaves.join(found, reduce(lambda a, b: a & b, keys), "left").select(*leaves.columns, F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def place(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """The order of an epoch: hex digits of a hash of seed, epoch and document."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), tie).cast("binary"))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], total: int | None = None, share: float = 1.0, max_epochs: int = 2, seed: int = 17, per_bucket: int = 50_000, scratch: Scratch | None = None, domain: Callable[[Column], Column] = domain_of, tokens: Callable[[Column], Column] = tokens_of) -> DataFrame:
    """``docs`` as struct ``row`` with domain, lang, source, tokens, epoch (from 0) of each selected copy.

    total: tokens to select; by default ``share`` times those of docs.  domain: of a source's name; tokens: of a text.  Rows of equal doc_id and text are ordered by their
    text's hash and then taken or left together by ties: equal rows in an epoch have equal places, and all of them go in if
    the last fits.  Null domains, languages and sources are values of their own; a null doc_id counts as "null"; null and
    empty texts have no tokens and come with whole epochs, or where the prefix reaches them.  An empty table gives an
    empty table.  Columns of docs may have any name.
    """
    rows = packed(docs, "doc_id", "text", "lang", "source")
    rows = rows.select("row", F.col("in_doc_id").alias("id"), F.md5(F.coalesce(F.col("in_text"), F.lit("")).cast("binary")).alias("tie"), tokens(F.col("in_text")).alias("tokens"), domain(F.col("in_source")).alias("domain"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"))
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    leaves = scratch.table(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    size = leaves.agg(F.sum("tokens").alias("t"), F.sum("rows").alias("n")).first()
    goal = int(math.floor((size.t or 0) * share)) if total is None else total
    few = F.broadcast if leaves.count() <= 10_000 else lambda t: t  # a tree of names; beyond that a shuffled join
    plan = budgets(leaves, weights, goal, max_epochs).withColumns({
        "whole": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)),
    }).withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = scratch.table(plan.select(*LEVELS, "whole", "part"), "plan")
    # leading hex digits of the hash: about per_bucket rows a bucket
    digits = 1
    while 16**digits * per_bucket < (size.n or 0) and digits < 7:
        digits += 1
    named = plan.select(*[F.col(c).alias(f"leaf_{c}") for c in LEVELS], "whole", "part")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in LEVELS])
    at = rows.join(few(named), same).drop(*[f"leaf_{c}" for c in LEVELS])
    at = at.withColumn("place", place(seed, F.col("whole"), F.col("id"), F.col("tie"))).withColumn("bucket", F.substring("place", 1, digits))
    sums = at.groupBy(*LEVELS, "part", "bucket").agg(F.sum("tokens").alias("sum"))
    running = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("until", running).withColumn("before", F.col("until") - F.col("sum"))
    # the bucket in which the prefix ends: the first that goes over the part
    ends = ends.where("until > part and before <= part")
    ends = ends.groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("end"))
    ends = scratch.table(ends.select(*[F.col(c).alias(f"end_{c}") for c in LEVELS], F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before")), "ends")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"end_{c}")) for c in LEVELS])
    # inside that bucket the rows are ordered
    last = at.select(*LEVELS, "part", "bucket", "place", "tokens").join(few(ends), same & (F.col("bucket") == F.col("end_bucket")))
    order = Window.partitionBy(*LEVELS).orderBy("place")
    last = last.withColumn("until", F.col("end_before") + F.sum("tokens").over(order)).where("until <= part")
    last = last.groupBy(*[F.col(c).alias(f"end_{c}") for c in LEVELS]).agg(F.max("place").alias("last_place"))
    limits = scratch.table(ends.join(last.select(*[F.col(f"end_{c}").alias(f"in_{c}") for c in LEVELS], "last_place"), reduce(lambda a, b: a & b, [F.col(f"end_{c}").eqNullSafe(F.col(f"in_{c}")) for c in LEVELS]), "left").drop(*[f"in_{c}" for c in LEVELS]), "limits")
    at = at.join(few(limits), same, "left")
    # no such bucket: the leaf has no more than its part
    inside = F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")) | F.coalesce((F.col("bucket") == F.col("end_bucket")) & (F.col("place") <= F.col("last_place")), F.lit(False))
    inside = inside & (F.col("part") > 0)
    copies = F.col("whole") + F.when(inside, 1).otherwise(0)
    at = at.withColumn("copies", copies.cast("int")).where("copies > 0")
    return at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("row", *LEVELS, "id", "tokens", "epoch")

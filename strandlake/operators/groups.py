"""Aggregations over groups of reads: N50, consensus, merged mates, pairs, assembly per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.session import tasks_for

#: Bytes of input for each task that makes pairs.
EACH = 4 << 20


def n50(df: DataFrame, size: str | Column, limit: int | None = None) -> DataFrame:
    """One row ``n50``: the largest size at which the running sum, from the largest down, exceeds ``limit``.

    The default limit is half of the sum, rounded down. Null if the sum never exceeds it.
    Sizes are summed per distinct value first, so the ordered window sees only distinct
    sizes, and ties need no order.
    """
    size = F.col(size) if isinstance(size, str) else size
    by = df.select(size.cast("long").alias("v")).where("v is not null").groupBy("v").agg((F.col("v") * F.count(F.lit(1))).alias("s"))
    run = F.sum("s").over(Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("s").over(Window.partitionBy()) if limit is None else None
    bound = F.floor(total / 2) if limit is None else F.lit(limit)
    return by.select("v", run.alias("run"), bound.alias("bound")).agg(F.max(F.when(F.col("run") > F.col("bound"), F.col("v"))).alias("n50"))


def consensus(df: DataFrame, key: str, seq: str) -> DataFrame:
    """key, n, seq: the column-wise majority of each group's sequences.

    A single sequence comes back as it is. Otherwise each column gets the base with most
    votes, the first of a, t, g, c among equals; a column without votes gives a. The
    result is as long as the longest sequence. Votes are partial sums per (key, place),
    so no group's sequences meet in one task before they are counted.
    """
    d = df.select(F.col(key).alias("key"), F.col(seq).alias("seq")).where(F.col("seq").isNotNull())
    stat = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("only"))
    # A group of one needs no vote.
    voters = d.join(stat.where("n > 1").select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    chars = voters.where(F.length("seq") > 0).select("key", F.posexplode(F.split("seq", "")).alias("pos", "ch"))
    count = lambda b: F.sum((F.col("ch") == b).cast("long")).alias(b)
    votes = chars.groupBy("key", "pos").agg(*map(count, "atgc"))
    best = F.greatest("a", "t", "g", "c")
    pick = F.when(F.col("a") == best, "a").when(F.col("t") == best, "t").when(F.col("g") == best, "g").otherwise("c")
    merged = votes.select("key", F.struct("pos", pick.alias("ch")).alias("x")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ch"]), "").alias("merged"))
    j = stat.join(merged.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
    return j.select("key", "n", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("merged", F.lit(""))).alias("seq"))


def pair_merge(df: DataFrame, key: str, d: str, seq: str, strict: bool = False) -> DataFrame:
    """id, d, seq: the two sequences of each key, the first by ``d`` and the reversed second.

    Keys with another number of rows are left out, or raise an error if ``strict``.
    """
    g = df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(d).alias("d"), F.col(seq).alias("s"))).alias("a"), F.max(F.struct(F.col(d).alias("d"), F.col(seq).alias("s"))).alias("b"))
    merged = F.concat(F.col("a.s"), F.reverse(F.col("b.s")))
    if strict:
        merged = F.when(F.col("n") == 2, merged).otherwise(F.raise_error(F.lit("a key has not exactly two reads")).cast("string"))
    else:
        g = g.where("n = 2")
    return g.select("id", F.lit(0).alias("d"), merged.alias("seq"))


def value_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b with a < b for all unordered pairs of unequal values of a key, repeats kept.

    A null among a key's values leaves the key without pairs. Pairs are counted from
    distinct values and their multiplicities, then repeated. Rows are dealt once, to as many
    tasks as their size asks for, so what a task sorts does not grow with the input; the
    distinct values of a key, far fewer than its pairs, are one row.
    """
    d = df.select(F.col(key).alias("key"), F.col(value).alias("v")).where("key is not null").repartition(tasks_for(df, EACH), "key")
    c = d.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    c = c.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("all"), F.bool_or(F.col("v").isNull()).alias("bad")).where(~F.col("bad") & (F.size("all") > 1))
    p = c.select("key", "all", F.posexplode("all").alias("i", "a")).select("key", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return p.select("key", F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.explode(F.array_repeat(F.lit(0), (F.col("a.n") * F.col("b.n")).cast("int"))).alias("_")).select("key", "a", "b")


def joined_values(df: DataFrame, key: str, value: str, sep: str = "\t") -> DataFrame:
    """key, values: a key's values in order, joined by ``sep``."""
    return df.groupBy(F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias("values"))


def per_group(df: DataFrame, key: str, work: Callable, schema: str) -> DataFrame:
    """``work`` on the pandas frame of each key; the frame of one key must fit in a task."""
    return df.groupBy(key).applyInPandas(work, schema)

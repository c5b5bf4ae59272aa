"""Mixing sources to target weights.

Sizes are summed per source with map-side partial sums; targets come from one sorted
pass over the source totals (one row per source); each document then takes
``floor(rate)`` copies plus one hash-seeded Bernoulli copy with probability equal to
the fraction. Only built-in expressions run, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.session import cut_lineage

#: The table of targets is broadcast up to so many sources and bytes of their names, which are counted first.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 4 << 20
#: Beyond that it is joined by source and salt, each source dealt to so many tasks.
SALTS = 16
#: Fixed value: what counts as a word.
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(totals: DataFrame, cycle: int = 3, most: float = 3.0) -> DataFrame:
    """Adds weight and target to rows of (source, source_size).

    Sources by code point, null last, weigh 1..``cycle``, repeating. All of the words are
    shared by weight; a target stops at ``most`` times its source and the excess is shared
    again. The fixed point is a water level: with sources sorted by ``cap / weight``, the
    level is what remains after the first i caps, over the weights that remain, at the
    first i whose ratio is not below it. Sources without words get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.sum("weight").over(after)})
    w = w.withColumn("level", F.col("left") / F.col("weights"))
    w = w.withColumn("place", F.row_number().over(by_ratio))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"])
    return w.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def mixed(docs: DataFrame, seed: int = 8, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: int = 3, most: float = 3.0) -> DataFrame:
    """All columns of ``docs`` (as a struct ``doc``) with size, source_size, target, rate, copies.

    Null texts have no words; a null source is a source of its own; rows that repeat an
    id draw the same number. A source without words has rate 0, so its documents take
    none. Texts of any length are counted whole. Columns of any name come back inside
    ``doc``. An empty table gives an empty result.
    """
    src, key = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), src.alias("source"), unit_hash(key, seed).alias("u"), words(F.col(f"`{text_col}`")).alias("size"))
    totals = docs.select(src.alias("source"), words(F.col(f"`{text_col}`")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut_lineage(targets(totals, cycle, most).withColumnRenamed("source", "goal_source"))
    n, size = goal.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("goal_source")), F.lit(0))).first()
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    if n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES:
        j = sized.join(F.broadcast(goal), same)
    else:
        sized = sized.withColumn("salt", F.floor(F.col("u") * SALTS).cast("int"))
        goal = goal.withColumn("goal_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = sized.join(goal, same & (F.col("salt") == F.col("goal_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = j.withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return j.select("doc", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns, whatever their names.

    As in :func:`mixed`: null texts have no words and count 0, a null source is one of
    its own, rows that repeat are drawn alike, so all or none of them get the extra copy.
    Texts of any length are counted whole and never leave the JVM. An empty table gives
    an empty result.
    """
    m = mixed(docs, **options)
    m = m.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return m.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])

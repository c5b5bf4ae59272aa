"""K-mer profiles and distances between them.

Distances of all pairs are products of matrices of counts, block by block, as the grid of
ids is what the operation asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import canonical
from strandlake.operators import coded
from strandlake.plans.session import ship_package, tasks_for

#: The k up to which canonical k-mers are looked up, and the bytes of input for each task that adds them up.
SHORT, EACH = 6, 8 << 20


def counts(df: DataFrame, key: str, seq: str | Column, k: int, canon: bool = False) -> DataFrame:
    """id, kmer, cnt for each distinct k-mer (or canonical k-mer) of each id."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    if canon and k <= SHORT:
        # Dealt by id once, which serves what is done for each id afterwards too.
        c = coded.kmer_counts(df.select(F.col(key).alias("id"), seq.alias("seq")), ["id"], F.col("seq"), k, canon=True)
        c = c.select("id", "lo", "cnt").repartition(tasks_for(df, EACH), "id").groupBy("id", "lo").agg(F.sum("cnt").alias("cnt"))
        return c.select("id", F.get(F.lit(coded.short_texts(k)), F.col("lo").cast("int")).alias("kmer"), "cnt")
    c = coded.kmer_counts(df.select(F.col(key).alias("id"), seq.alias("seq")), ["id"], F.col("seq"), k)
    c = c.groupBy("id", *coded.KMER).agg(F.sum("cnt").alias("cnt")).select("id", coded.text_of(k).alias("kmer"), "cnt")
    if canon:
        c = c.select("id", canonical(F.col("kmer")).alias("kmer"), "cnt").where("kmer is not null").groupBy("id", "kmer").agg(F.sum("cnt").alias("cnt"))
    return c


def norm_length(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, length: the Euclidean norm of each key's values."""
    return df.groupBy(F.col(key).alias("key")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("length"))


def profile(df: DataFrame, key: str, seq: str | Column, k: int = 4) -> DataFrame:
    """id, length, kmer, cnt, normlen: canonical k-mer counts divided by their norm."""
    c = counts(df, key, seq, k, canon=True)
    length = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy("id")))
    return c.withColumn("length", length).withColumn("normlen", F.col("cnt") / F.col("length"))


def nested_profile(df: DataFrame, key: str, seq: str | Column, k: int = 4) -> DataFrame:
    """id, length, profile: one row per id with an array of (kmer, normlen)."""
    p = profile(df, key, seq, k)
    return p.groupBy("id", "length").agg(F.array_sort(F.collect_list(F.struct("kmer", "normlen"))).alias("profile"))


def vector_distance(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, distance between the columns a and b of each key, both divided by their norms; a norm of 0 counts as 1."""
    w = Window.partitionBy("key")
    d = df.select(F.col(key).alias("key"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(w))
    d = d.withColumns({"la": norm("a"), "lb": norm("b")})
    unit = lambda c, n: F.col(c) / F.when(F.col(n) == 0, 1.0).otherwise(F.col(n))
    return d.groupBy("key").agg(F.sqrt(F.sum(F.pow(unit("a", "la") - unit("b", "lb"), 2))).alias("distance"))


def _pairs(c: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str, block: int = 512) -> DataFrame:
    """id1, id2, distance for all pairs of ids of (id, kmer, cnt).

    Ids are dealt to blocks; each pair of blocks is one product of two matrices in a task,
    so nothing but the result itself, which is asked for, grows with the square of the ids.
    ``of``: distances from the dot products and each side's squared norms.
    """
    spark = c.sparkSession
    ship_package(spark)
    ids = c.groupBy("id").agg(F.collect_list(F.xxhash64("kmer")).alias("k"), F.collect_list("cnt").alias("n"))
    n = max(1, -(-ids.count() // block))
    held = ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").agg(F.collect_list("id").alias("id"), F.collect_list("k").alias("k"), F.collect_list("n").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select(F.col("block").alias("i"), each.alias("j"), F.col("id").alias("id1"), F.col("k").alias("k1"), F.col("n").alias("n1"))
    right = held.select(F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("n").alias("n2"))

    def matrix(keys: list[list[int]], counts: list[list[int]], names: np.ndarray) -> np.ndarray:
        m = np.zeros((len(keys), len(names)))
        for r, (k, v) in enumerate(zip(keys, counts, strict=True)):
            m[r, np.searchsorted(names, k)] = v
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                id1, k1, n1, id2, k2, n2 = (b.column(x)[r] for x in range(6))
                k1, n1, k2, n2 = (x.as_py() for x in (k1, n1, k2, n2))
                names = np.unique(np.array([x for k in (*k1, *k2) for x in k], np.int64))
                x, y = matrix(k1, n1, names), matrix(k2, n2, names)
                d = of(x @ y.T, (x * x).sum(1), (y * y).sum(1)).reshape(-1)
                a, z = id1.values, id2.values
                yield pa.record_batch([a.take(pa.array(np.repeat(np.arange(len(a)), len(z)))), z.take(pa.array(np.tile(np.arange(len(z)), len(a)))), pa.array(d)], names=["id1", "id2", "distance"])

    t = c.schema["id"].dataType.simpleString()
    return left.join(right, ["i", "j"]).select("id1", "k1", "n1", "id2", "k2", "n2").mapInArrow(run, f"id1 {t}, id2 {t}, distance {kind}")


def pairwise_distance(df: DataFrame, key: str, seq: str | Column, k: int) -> DataFrame:
    """id1, id2, distance for all pairs, an id with itself too: Euclid between normalised k-mer counts."""
    return _pairs(counts(df, key, seq, k), lambda dot, a, b: np.sqrt(np.maximum(0.0, 2 - 2 * dot / (np.sqrt(a)[:, None] * np.sqrt(b)))), "double")


def pairwise_set_distance(df: DataFrame, key: str, seq: str | Column, k: int) -> DataFrame:
    """id1, id2, distance for all pairs: k-mers that only one of the two has."""
    c = counts(df, key, seq, k).withColumn("cnt", F.lit(1).cast("long"))
    return _pairs(c, lambda dot, a, b: np.rint(a[:, None] + b - 2 * dot).astype(np.int64), "long")

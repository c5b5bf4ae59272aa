"""K-mer counts over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.kmers import chunks, kmers
from strandlake.sources.fasta import parse_fasta


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTA files as they arrive in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(path)
    return parse_fasta(raw.where(F.trim("value") != ""))


def kmer_counts(reads: DataFrame, seq: str, k: int) -> DataFrame:
    """Running counts per k-mer; write them in update or complete mode."""
    parts = reads.select(F.explode(chunks(F.col(seq), k)).alias("part"))
    return parts.select(F.explode(kmers(F.col("part"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_kmer_counts(reads: DataFrame, time: str, seq: str, k: int, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and k-mer; windows close when the watermark has passed."""
    r = reads.withWatermark(time, late).select(time, F.explode(chunks(F.col(seq), k)).alias("part"))
    r = r.select(time, F.explode(kmers(F.col("part"), k)).alias("kmer"))
    return r.groupBy(F.window(time, width), "kmer").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kmer", "cnt")

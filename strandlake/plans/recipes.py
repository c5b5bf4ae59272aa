"""Whole analyses, each from DataFrames of reads to a result."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.kmers import chunks, kmers, neighbours
from strandlake.functions.sequences import identity_hash, subsequence
from strandlake.operators import coded, external, groups, matching, profiles


#: K-mers of up to so many bases are few enough to be put together before they leave a task.
FEW = 12


def parameters(spark: SparkSession, recipe: Callable, **given: object) -> dict[str, object]:
    """Keyword arguments of a recipe: as given, else as the session sets ``strandlake.<recipe>.<name>``, else its defaults.

    Settings are text and take the type of the default.
    """
    out = {}
    for name, p in inspect.signature(recipe).parameters.items():
        if name in given:
            out[name] = given[name]
        elif p.default is not p.empty and (text := spark.conf.get(f"strandlake.{recipe.__name__}.{name}", None)) is not None:
            kind = type(p.default)
            out[name] = text.lower() == "true" if kind is bool else text if p.default is None or kind is str else kind(text)
    return out


def _sums(reads: DataFrame, seq: str | Column, k: int, n_too: bool = False) -> DataFrame:
    c = coded.kmer_counts(reads, [], F.col(seq) if isinstance(seq, str) else seq, k, n_too)
    return c.groupBy(*coded.KMER).agg(F.sum("cnt").alias("cnt"))


def kmer_count(reads: DataFrame, seq: str | Column, k: int = 30) -> DataFrame:
    """kmer, cnt."""
    if k > 2 * coded.per_long(False):
        return _kmer_rows(reads, seq, k).groupBy("kmer").agg(F.count("kmer").alias("cnt"))
    if k > FEW:
        return coded.summed_kmers(reads, F.col(seq) if isinstance(seq, str) else seq, k)
    return _sums(reads, seq, k).select(coded.text_of(k).alias("kmer"), "cnt")


def kmer_stats(reads: DataFrame, seq: str | Column, k: int = 30) -> DataFrame:
    """cnt, n_kmers: how many k-mers occur so often."""
    if FEW < k <= 2 * coded.per_long(False):
        return coded.summed_kmers(reads, F.col(seq) if isinstance(seq, str) else seq, k, "stats")
    counted = kmer_count(reads, seq, k) if k > 2 * coded.per_long(False) else _sums(reads, seq, k)
    return counted.groupBy("cnt").agg(F.count(F.lit(1)).alias("n_kmers"))


def kmer_set(reads: DataFrame, seq: str | Column, k: int = 40) -> DataFrame:
    """Distinct k-mers."""
    if k > 2 * coded.per_long(False):
        return _kmer_rows(reads, seq, k).distinct()
    if k > FEW:
        return coded.summed_kmers(reads, F.col(seq) if isinstance(seq, str) else seq, k, "set")
    return coded.kmer_counts(reads, [], F.col(seq) if isinstance(seq, str) else seq, k).select(*coded.KMER).distinct().select(coded.text_of(k).alias("kmer"))


def _kmer_rows(reads: DataFrame, seq: str | Column, k: int) -> DataFrame:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return reads.select(F.explode(chunks(seq, k)).alias("part")).select(F.explode(kmers(F.col("part"), k)).alias("kmer"))


def kmer_profile(reads: DataFrame, key: str, seq: str | Column, k: int = 4) -> DataFrame:
    return profiles.profile(reads, key, seq, k)


def tetranucleotide_distance(reads: DataFrame, key: str, seq: str | Column, k: int = 1) -> DataFrame:
    return profiles.pairwise_distance(reads, key, seq, k)


def set_distance(reads: DataFrame, key: str, seq: str | Column, k: int = 4) -> DataFrame:
    return profiles.pairwise_set_distance(reads, key, seq, k)


def n50(contigs: DataFrame, size: str | Column, limit: int | None = None) -> DataFrame:
    return groups.n50(contigs, size, limit)


def dereplicate(reads: DataFrame, key: str, d: str, seq: str, distance: int = 1) -> DataFrame:
    """hash, n, seq: mates merged, keyed by their end hash and its neighbours, counted, with a consensus."""
    merged = groups.pair_merge(reads, key, d, seq).select("id", "seq", F.explode(neighbours(identity_hash(F.col("seq")), distance)).alias("hash"))
    # Hashes travel with a row's id; its sequence follows once it is known where it is wanted.
    keyed = merged.select("hash", "id")
    stat = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    seqs = groups.pair_merge(reads, key, d, seq).select("id", "seq")
    single = stat.where("n = 1").join(seqs, "id").select("hash", "n", "seq")
    shared = keyed.join(stat.where("n > 1").select("hash"), "hash", "left_semi").join(seqs, "id").select("hash", "seq")
    return single.unionByName(groups.consensus(shared, "hash", "seq").withColumnRenamed("key", "hash"))


def assign_barcodes(reads: DataFrame, barcodes: DataFrame, key: str, seq: str | Column, barcode_key: str, barcode_seq: str | Column, length: int = 10, distance: int = 2, distinct: bool = False) -> DataFrame:
    """barcode, read: reads whose first bases differ from a barcode in ``distance`` places at most."""
    seq, barcode_seq = (F.col(c) if isinstance(c, str) else c for c in (seq, barcode_seq))
    r = reads.select(F.col(key).alias("read"), subsequence(seq, 0, length).alias("start"))
    b = barcodes.select(F.col(barcode_key).alias("barcode"), barcode_seq.alias("code"))
    out = matching.fuzzy_join(r, b, "start", "code", distance).select("barcode", "read")
    return out.distinct() if distinct else out


def screening(reads: DataFrame, database: DataFrame, key: str, seq: str | Column, db_seq: str | Column, k: int = 30, exclude: str | None = None) -> DataFrame:
    return matching.screen(reads, database, key, seq, db_seq, k, exclude)


def contig_kmer(contigs: DataFrame, reads: DataFrame, contig_key: str, contig_seq: str | Column, read_key: str, read_seq: str | Column, k: int) -> DataFrame:
    """contig, reads: for each contig the sorted reads that share a k-mer with it."""
    p = matching.shared_kmers(contigs, reads, contig_key, contig_seq, read_key, read_seq, k)
    return p.groupBy("contig").agg(F.array_sort(F.collect_list("read")).alias("reads"))


def gene_assembly(reads: DataFrame, query: str, blast_tool: external.Tool = external.TOOLS["blast"], assembler: external.Tool = external.TOOLS["velvet"]) -> DataFrame:
    """group, contig, seq: hits of a query, their mates recovered, assembled per gene."""
    hits = external.blast(reads, query, blast_tool).select(F.col("geneid"), F.col("id")).distinct()
    return external.assemble_longest(hits.join(reads.select("id", "d", "seq"), "id"), "geneid", assembler)


def extend_contigs(contigs: DataFrame, reads: DataFrame, contig_key: str, contig_seq: str, read_key: str, read_seq: str, k: int = 20, ends: int = 10, tool: external.Tool = external.TOOLS["cap3"]) -> DataFrame:
    """group, seq, extended: contigs with the reads that share a k-mer with one of their ends."""
    p = matching.shared_kmers(contigs, reads, contig_key, contig_seq, read_key, read_seq, k, start=0, num=ends, both_ends=True)
    r = reads.select(F.col(read_key).alias("read"), F.col(read_seq).alias("seq"))
    near = p.join(r, "read").select(F.col("contig").cast("string").alias("group"), F.col("read").cast("string").alias("id"), F.lit(0).alias("d"), "seq")
    c = contigs.select(F.col(contig_key).cast("string").alias("group"), F.col(contig_seq).alias("seq"))
    return external.extend_contig(c, near, "group", tool)

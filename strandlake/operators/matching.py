"""Joins by shared or nearly equal k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.kmers import kmers, mismatches, neighbours
from strandlake.operators import coded

#: Rows and bytes of text up to which a side is broadcast after they have been counted; more is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def bounded(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and their bytes as text are few, which is counted; else as it is."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(row)), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _kmer_rows(df: DataFrame, keys: list[str], seq: Column, k: int, n_too: bool = False) -> DataFrame:
    return coded.kmer_counts(df, keys, seq, k, n_too).select(*keys, *coded.KMER)


def _coded(rows: DataFrame, k: int) -> DataFrame:
    """Rows with a text column ``kmer`` of ``k`` bases, as the columns of a coded k-mer instead."""
    keep = [c for c in rows.columns if c != "kmer"]
    return _kmer_rows(rows, keep, F.col("kmer"), k)


def kmer_index(df: DataFrame, key: str, seq: str | Column, k: int, **args) -> DataFrame:
    """Distinct (id, coded k-mer); ``args`` choose the windows."""
    d = df.select(F.col(key).alias("id"), _col(seq).alias("seq"))
    if not args:
        return _kmer_rows(d, ["id"], F.col("seq"), k).distinct()
    return _coded(d.select("id", F.explode(kmers(F.col("seq"), k, **args)).alias("kmer")), k).distinct()


def screen(reads: DataFrame, database: DataFrame, key: str, seq: str | Column, db_seq: str | Column, k: int = 30, exclude: str | None = None) -> DataFrame:
    """Distinct ids of reads that share a k-mer with the database.

    ``exclude``: a pattern; k-mers of the database that it matches in full are not used.
    """
    db = _kmer_rows(database, [], _col(db_seq), k).distinct()
    if exclude is not None:
        db = db.where(~coded.text_of(k).rlike(f"^(?:{exclude})$"))
    r = _kmer_rows(reads.select(F.col(key).alias("id"), _col(seq).alias("seq")), ["id"], F.col("seq"), k)
    return r.join(bounded(db), coded.KMER, "left_semi").select("id").distinct()


def shared_kmers(contigs: DataFrame, reads: DataFrame, contig_key: str, contig_seq: str | Column, read_key: str, read_seq: str | Column, k: int, **args) -> DataFrame:
    """Distinct (contig, read) that share a k-mer; ``args`` choose the windows of contigs, as their ends."""
    c = kmer_index(contigs, contig_key, contig_seq, k, **args).withColumnRenamed("id", "contig")
    r = _kmer_rows(reads.select(F.col(read_key).alias("read"), _col(read_seq).alias("seq")), ["read"], F.col("seq"), k)
    return r.join(bounded(c), coded.KMER).select("contig", "read").distinct()


def kmer_match(reads: DataFrame, database: DataFrame, seq: str | Column, db_key: str, db_seq: str | Column, k: int, all_windows: bool = False) -> DataFrame:
    """Distinct ids of the database that share a window with any read; windows with n count.

    As the operation is defined the last two windows of a sequence are left out;
    ``all_windows`` takes them in. The database's distinct windows decide which windows of
    the reads are looked at at all, and only hits are shuffled.
    """

    def cut(s: Column) -> Column:
        return s if all_windows else F.substring(s, F.lit(1), F.greatest(F.length(s) - 2, F.lit(0)))

    d = _kmer_rows(database.select(F.col(db_key).alias("id"), cut(_col(db_seq)).alias("seq")), ["id"], F.col("seq"), k, True)
    r = _kmer_rows(reads, [], cut(_col(seq)), k, True)
    hit = r.join(bounded(d.select(*coded.KMER).distinct()), coded.KMER, "left_semi").distinct()
    return d.join(hit, coded.KMER, "left_semi").select("id").distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_seq: str, right_seq: str, d: int) -> DataFrame:
    """All columns of both for rows whose sequences differ in ``d`` places at most; both have one length.

    The right side, which should be the small one, is expanded to its neighbours and
    broadcast where their number allows it.
    """
    r = right.select("*", F.explode(neighbours(F.col(right_seq), d)).alias("__near"))
    return left.join(bounded(r), F.col(left_seq) == F.col("__near")).drop("__near")


def seed_join(left: DataFrame, right: DataFrame, left_seq: str, right_seq: str, d: int) -> DataFrame:
    """As :func:`fuzzy_join`, for larger ``d``: d + 1 exact segments as seeds, then mismatches are counted.

    Sequences within ``d`` mismatches agree in one of d + 1 segments, so no pair is missed.
    """
    def seeds(df: DataFrame, seq: str, name: str) -> DataFrame:
        return df.select(F.struct("*").alias(name), F.posexplode(segments(F.col(seq))).alias("i", "s"), F.length(seq).alias("n"))

    def segments(c: Column) -> Column:
        n = F.length(c)
        return F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.substring(c, F.floor(i * n / (d + 1)).cast("int") + 1, (F.floor((i + 1) * n / (d + 1)) - F.floor(i * n / (d + 1))).cast("int")))

    a, b = seeds(left, left_seq, "l"), seeds(right, right_seq, "r")
    x, y = F.col(f"l.{left_seq}"), F.col(f"r.{right_seq}")
    # Each pair once, at its first segment that agrees, so that rows that repeat stay as often as they are.
    first = F.array_position(F.zip_with(segments(x), segments(y), lambda p, q: p == q), F.lit(True)) - 1
    j = a.join(b, ["n", "i", "s"]).where((first == F.col("i")) & (mismatches(x, y) <= d))
    return j.select("l.*", "r.*")

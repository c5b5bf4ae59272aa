"""Column functions on nucleotide strings: lower case over the alphabet a, t, g, c, n.

All but the 64-bit hash is built from Spark's own expressions, so that it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the order of the alphabet in packed forms and votes.
ALPHABET = "atgcn"
#: Fixed value: the start of the 64-bit polynomial hash.
HASH_START = 1125899906842597


def normalise(seq: Column) -> Column:
    return F.lower(seq)


def from_text(text: Column) -> Column:
    """A nucleotide string from any text: ASCII letters only, folded onto the alphabet; z becomes n."""
    letters = F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "atgc" * 6 + "an")


def complement(seq: Column) -> Column:
    return F.translate(seq, "atgc", "tacg")


def reverse_complement(seq: Column) -> Column:
    """Characters outside the alphabet are dropped."""
    return F.reverse(complement(F.regexp_replace(seq, "[^acgtn]", "")))


def canonical(kmer: Column, strict: bool = False) -> Column:
    """The lesser of a k-mer and its reverse complement; other characters than acgt give null, or an error if ``strict``."""
    other = F.raise_error(F.concat(F.lit("not a k-mer: "), kmer)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(kmer.isNull(), None).when(kmer.rlike("^[acgt]*$"), F.least(kmer, F.reverse(complement(kmer)))).otherwise(other)


def subsequence(seq: Column, start: int | Column, end: int | Column) -> Column:
    """Characters from ``start`` (0-based) to ``end`` (exclusive); null where that is empty or beyond the sequence."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    ok = (start >= 0) & (end > start) & (end <= F.length(seq))
    return F.when(ok, F.substring(seq, start + 1, end - start))


def identity_hash(seq: Column, n: int = 16) -> Column:
    """The first ``n`` bases and the last ``n`` reversed; null for shorter sequences."""
    return F.when(F.length(seq) >= n, F.concat(F.substring(seq, 1, n), F.substring(F.reverse(seq), 1, n)))


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def hash_long(s: Column) -> Column:
    """h = 31 h + c over 64 bits with wrap-around, from a fixed start; null gives 0, as the empty string does.

    Characters count by their code points, in blocks that are one product of arrays each.
    """
    return _hash_rows()(s)


def hash_of(text: str | None, block: int = 1 << 12) -> int:
    """The hash of :func:`hash_long` of one string."""
    if not text:
        return 0
    h, most = HASH_START, (1 << 64) - 1
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.append(np.uint64(1), np.full(min(block, len(x)) - 1, 31, np.uint64)))[::-1]
    for i in range(0, len(x), block):
        part = x[i : i + block]
        h = (h * pow(31, len(part), 1 << 64) + int(np.dot(part, powers[len(powers) - len(part) :]))) & most
    return h - (1 << 64) if h >> 63 else h


def _hash_rows() -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([hash_of(x) for x in values], dtype="int64")

    return run


def string_hash(s: Column) -> Column:
    """The 32-bit polynomial hash of a string, as a signed int."""
    h = F.aggregate(_characters(s), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h > 0x7FFFFFFF, h - F.lit(1 << 32)).otherwise(h).cast("int")


def replace_at(s: Column, i: int | Column, c: str | Column) -> Column:
    """``s`` with the character at ``i`` (0-based) replaced."""
    i, c = i if isinstance(i, Column) else F.lit(i), c if isinstance(c, Column) else F.lit(c)
    return F.overlay(s, c, i + 1, F.lit(1))


def merge_pair(first: Column, second: Column) -> Column:
    """The first read with the second reversed (not complemented)."""
    return F.concat(first, F.reverse(second))


def num_bases(seq: Column) -> Column:
    return F.length(seq)


def mate(header: Column) -> tuple[Column, Column]:
    """(id, d) of a read name: ``id/1`` and ``id/2`` part at the slash; d is 0 without one."""
    name = F.regexp_extract(header, "^([^ \\t]*)", 1)
    paired = F.instr(name, "/") > 0
    d = F.element_at(F.split(name, "/"), 2)
    return F.substring_index(name, "/", 1), F.when(paired, F.coalesce(F.expr("try_cast(null as int)"), d.try_cast("int"))).otherwise(F.lit(0))

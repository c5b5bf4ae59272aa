"""The column functions by name, for use in SQL text.

Those made of built-in expressions are SQL functions, which are inlined in the plan; the
packed forms are Arrow functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandlake.functions import codecs
from strandlake.plans.session import ship_package

#: Signature, result and body of each SQL function.
FUNCTIONS = {
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(regexp_replace(s, '[^acgtn]', ''), 'atgc', 'tacg'))"),
    "canonical_kmer": ("s STRING", "STRING", "CASE WHEN s RLIKE '^[acgt]*$' THEN least(s, reverse(translate(s, 'atgc', 'tacg'))) END"),
    "subsequence": ("s STRING, a INT, b INT", "STRING", "CASE WHEN a >= 0 AND b > a AND b <= length(s) THEN substring(s, a + 1, b - a) END"),
    "identity_hash": ("s STRING, n INT", "STRING", "CASE WHEN length(s) >= n THEN concat(substring(s, 1, n), substring(reverse(s), 1, n)) END"),
    "merge_pair": ("a STRING, b STRING", "STRING", "concat(a, reverse(b))"),
    "num_bases": ("s STRING", "INT", "length(s)"),
    "replace_base": ("s STRING, i INT, c STRING", "STRING", "overlay(s PLACING c FROM i + 1 FOR 1)"),
    "kmers": ("s STRING, k INT", "ARRAY<STRING>", "CASE WHEN length(s) >= k THEN regexp_extract_all(s, concat('(?s)(?=([^n]{', k, '}))'), 1) END"),
}
_PACKED = {"pack_bases": (codecs.pack_bytes, "binary"), "unpack_bases": (codecs.unpack_bytes, "string"), "pack7_bases": (codecs.pack7_bytes, "binary"), "unpack7_bases": (codecs.unpack7_bytes, "string")}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; returns their names."""
    ship_package(spark)
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (work, kind) in _PACKED.items():
        spark.udf.register(name, codecs.arrow_function(work, kind))
    return [*FUNCTIONS, *_PACKED]

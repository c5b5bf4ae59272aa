"""A table with nulls in every column, empty, blank and very long texts, ties, repeats and clashing extra columns."""

from pyspark.sql import types as T

EXTRA = ["size", "kept", "score", "label", "text_sha256", "doc", "id", "fp", "page", "source_size", "len", "keep_id", "__id", "__sha", "__len", "__kid", "sha", "row", "k", "s", "at", "none", "dotted.name", "tgt.text"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)
LONG = "lorem ipsum dolor sit amet consectetur " * 6000


def rows():
    base = [
        (1, "a b c", "en", "s1", 5),
        (2, None, None, None, None),
        (3, "", "en", "s2", 0),
        (4, " \t\n", "en", None, 3),
        (5, "a  b\tc", "fr", "s1", 6),
        (None, "a b c", "en", "s1", 5),
        (None, "only null ids here", "en", "s3", 18),
        (7, LONG, "la", "s1", len(LONG)),
        (8, LONG + "end", "la", "s1", len(LONG) + 3),
        (9, "same row twice, with é and 日本", "en", "s2", 30),
        (9, "same row twice, with é and 日本", "en", "s2", 30),
        (9, "same id, other text", "en", "s2", 19),
    ]
    return [(*r, *("x" for _ in EXTRA)) for r in base]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""FASTA and FASTQ as DataFrames.

Both are read by the text source with a record separator, so large files are split and
codecs follow the suffix. A FASTQ quality line may begin like a header: then a record
comes in two chunks, which are told apart by their lines, since no sequence begins with
a plus sign. Only gzip files are one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.sequences import string_hash

READ = "id string, d int, seq string, header string"


def _name_parts(name: Column) -> tuple[Column, Column]:
    """``id/1`` and ``id/2`` part at the slash; d is 0 without one and null if it is no number."""
    slash = F.instr(name, "/") > 0
    return F.substring_index(name, "/", 1), F.when(slash, F.element_at(F.split(name, "/"), 2).try_cast("int")).otherwise(F.lit(0))


def parse_fasta(chunks: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records from text that lies between one header sign at the start of a line and the next.

    The header keeps its leading white space; a record without sequence has an empty one;
    line ends may be LF or CRLF; the sequence is folded to lower case.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r", ""), "^>", "")
    d = chunks.select(*keep, text.alias("t")).where(F.trim("t") != "")
    head = F.substring_index("t", "\n", 1)
    body = F.when(F.instr("t", "\n") > 0, F.substr(F.col("t"), F.instr("t", "\n") + 1)).otherwise("")
    name = F.regexp_extract(head, "^([^ \\t]*)", 1)
    i, dd = _name_parts(name)
    return d.select(*keep, i.alias("id"), dd.alias("d"), F.lower(F.regexp_replace(body, "\\s", "")).alias("seq"), F.substr(head, F.length(name) + 1).alias("header"))


def _first_of_file(at: Column, path: Column) -> Column:
    """True for the first row of each file, given the offset of a row's block in its file.

    Rows of a file's first block follow one another in a task; only a hash of the path
    leaves the JVM, and nothing for other blocks.
    """

    @F.pandas_udf("boolean")
    def first(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        last = None
        for h in hashes:
            before = h.shift(1)
            if len(h):
                before.iloc[0] = last
            yield h.notna() & (h != before)
            last = h.iloc[-1] if len(h) else last

    return first(F.when(at == 0, F.xxhash64(path).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, d, seq, header. Plain files and bzip2 are split; text before the first header of each file is dropped."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", _first_of_file(meta["file_block_start"], meta["file_path"]).alias("first"))
    # Only the first chunk of a file keeps its header sign; a first chunk without one is no record.
    return parse_fasta(raw.where(~F.col("first") | F.col("value").startswith(">")))


def read_fasta_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """block, reads: one row per input split with an array of its (id, d, seq)."""
    return blocks(read_fasta(spark, path))


def blocks(reads: DataFrame) -> DataFrame:
    """One row per partition with an array of its (id, d, seq), put together where it is; it must fit in a task, as splits do."""
    r = reads.select(F.struct("id", "d", "seq").alias("r"))
    kind = r.schema["r"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0) for b in batches if b.num_rows]
        if held:
            all_ = pa.concat_arrays(held)
            block = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_)], pa.int32()), all_)], names=["block", "reads"])

    return r.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("reads", T.ArrayType(kind))]))


def parse_fastq(chunks: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """name, seq from text that lies between one ``@`` at the start of a line and the next.

    Records have four lines; blank lines between them are passed over. A chunk of name,
    sequence and plus line is a record whose quality begins with ``@``; the rest of that
    quality is the next chunk, a single line, which is no record. Anything else is an error.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r", ""), "^@", "")
    lines = F.split(F.regexp_replace(text, "\n+$", ""), "\n")
    d = chunks.select(*keep, F.regexp_replace(text, "\n+$", "").alias("t"), F.split(text, "\n").alias("l"), F.size(lines).alias("n"))
    at = lambda i: F.get("l", F.lit(i))
    # An empty sequence or quality leaves blank lines that the count without them does not show.
    plus = F.coalesce(at(2), F.lit("")).startswith("+")
    whole = plus & (F.length(at(1)) == F.length(F.coalesce(at(3), F.lit("")))) & (F.col("n") <= 4)
    begun = plus & (F.col("n") == 3) & (F.length(at(1)) > 0)
    rest = (F.col("n") == 1) & ~plus
    bad = F.raise_error(F.concat(F.lit("a record is cut off or malformed: "), F.substring("t", 1, 60))).cast("string")
    d = d.where(~rest).select(*keep, "l", F.when(whole | begun, F.regexp_extract(at(0), "^([^ \\t]*)", 1)).otherwise(bad).alias("name"))
    return d.select(*keep, "name", at(1).alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], fold: bool = True, with_file: bool = False) -> DataFrame:
    """id, d, seq; ``with_file`` puts file_hash, the 32-bit hash of the file name, before them.

    ``fold``: sequences in lower case, as k-mer functions expect. Quality is dropped.
    Plain files and bzip2 are split. A file whose first line is no header is an error.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    r = parse_fastq(raw, keep=("file",))
    i, d = _name_parts(F.col("name"))
    seq = F.lower("seq") if fold else F.col("seq")
    out = [i.alias("id"), d.alias("d"), seq.alias("seq")]
    return r.select(string_hash(F.col("file")).alias("file_hash"), *out) if with_file else r.select(*out)


def read_fastq_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """block, reads: one row per partition of FASTQ files with an array of its (id, d, seq)."""
    return blocks(read_fastq(spark, path))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, seq: whole names, mates told apart as ``id/d``; one row per record of a file or folder."""
    r = read_fasta(spark, path)
    return r.select(F.when(F.col("d") > 0, F.concat("id", F.lit("/"), "d")).otherwise(F.col("id")).alias("name"), "seq")


def count_sequences(spark: SparkSession, path: str | list[str]) -> int:
    return read_fasta(spark, path).count()


def fasta_text(key: Column | None, value: Column) -> Column:
    """``>key`` and the value on a line of its own; a null key is written as ``value``, two nulls give null."""
    name = F.lit(None).cast("string") if key is None else key
    head = F.concat(F.lit(">"), F.coalesce(name, F.when(value.isNotNull(), F.lit("value"))))
    return F.when(head.isNotNull(), F.concat_ws("\n", head, value))


def write_fasta(df: DataFrame, path: str, key: str = "id", value: str = "seq", compression: str | None = None, mode: str = "errorifexists", with_length: bool = False) -> None:
    """One file per partition; ``compression``: gzip or bzip2; ``with_length`` adds `` length=N`` to headers.

    Rows with neither key nor value write nothing.
    """
    name = F.col(key).cast("string")
    if with_length:
        name = F.concat(name, F.lit(" length="), F.length(value).cast("string"))
    t = df.select(fasta_text(name, F.col(value).cast("string")).alias("value")).where("value is not null")
    t.write.mode(mode).text(path, compression=compression)


def serialised(c: Column, kind) -> Column:
    """A value as nested text: tuples in parentheses, bags in braces, maps in brackets with #."""
    empty = F.lit("")
    if isinstance(kind, T.StructType):
        inner = F.concat_ws(",", *[F.coalesce(serialised(c[f.name], f.dataType), empty) for f in kind.fields])
        return F.when(c.isNotNull(), F.concat(F.lit("("), inner, F.lit(")")))
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: F.coalesce(serialised(x, kind.elementType), empty)), ",")
        return F.when(c.isNotNull(), F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, T.MapType):
        inner = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("#"), F.coalesce(serialised(e["value"], kind.valueType), empty))), ",")
        return F.when(c.isNotNull(), F.concat(F.lit("["), inner, F.lit("]")))
    return c.cast("string")


def write_text(df: DataFrame, path: str, delimiter: str = "\t", compression: str | None = None, mode: str = "errorifexists") -> None:
    """Rows as delimited text, nested values written as :func:`serialised` does; nulls are empty."""
    cols = [F.coalesce(serialised(F.col(f"`{f.name}`"), f.dataType), F.lit("")) for f in df.schema.fields]
    df.select(F.concat_ws(delimiter, *cols).alias("value")).write.mode(mode).text(path, compression=compression)


def read_table(spark: SparkSession, path: str, schema: str, delimiter: str = "\t") -> DataFrame:
    """Delimited text with a given schema."""
    return spark.read.schema(schema).csv(path, sep=delimiter)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """group, reads: lines of a group id and read ids, parted by tabs; repeats stay."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("group"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("reads"))

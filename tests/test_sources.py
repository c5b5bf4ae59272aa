import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from strandlake.functions.sequences import string_hash
from strandlake.sources import fasta
from strandlake.streaming import kmer_stream


def test_fasta_forms(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text("junk\n>r1/1 has > inside\nACG\nTTn\n>r2/2\tx\r\nacg\r\n>empty\n>last\nga")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(p)).collect()]
    assert got == [("r1", 1, "acgttn", " has > inside"), ("r2", 2, "acg", "\tx"), ("empty", 0, "", ""), ("last", 0, "ga", "")]


@pytest.mark.parametrize("opener, suffix", [(gzip.open, ".gz"), (bz2.open, ".bz2")])
def test_fasta_compressed(spark, tmp_path, opener, suffix):
    p = tmp_path / f"a.fa{suffix}"
    with opener(p, "wt") as f:
        f.write("".join(f">r{i}\n{'acgt' * 5}\n" for i in range(200)))
    assert fasta.read_fasta(spark, str(p)).where("seq = repeat('acgt', 5)").count() == 200
    assert fasta.read_fasta_blocks(spark, str(p)).select(F.sum(F.size("reads"))).first()[0] == 200


def test_fasta_splits(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text("".join(f">r{i} a>b\n{'acgt' * (i % 9)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = fasta.read_fasta(spark, str(p))
        assert df.rdd.getNumPartitions() > 4
        assert df.select("id").distinct().count() == df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq(spark, tmp_path):
    p = tmp_path / "q.fastq"
    p.write_text("@SEQ_ID/1 x\r\nGATT\r\n+\r\n@>!!\r\n@b\nAC\n+b\n@@")
    assert [tuple(r) for r in fasta.read_fastq(spark, str(p)).collect()] == [("SEQ_ID", 1, "gatt"), ("b", 0, "ac")]
    named = fasta.read_fastq(spark, str(p), fold=False, with_file=True)
    want = spark.createDataFrame([("q.fastq",)], "n string").select(string_hash(F.col("n")).alias("h")).first().h
    assert [(r.file_hash, r.seq) for r in named.collect()] == [(want, "GATT"), (want, "AC")]
    p.write_text("@a\nACGT\n+\n!!")
    with pytest.raises(Exception, match="cut off"):
        fasta.read_fastq(spark, str(p)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "acgt"), (None, "gg"), (None, None)], "id string, seq string")
    fasta.write_fasta(df.coalesce(1), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == [">a", "acgt", ">value", "gg"]
    nested = spark.createDataFrame([((1, "x"), [2, 3], {"k": 4.5}, None)], "t struct<a:int,b:string>, b array<int>, m map<string,double>, n int")
    fasta.write_text(nested, str(tmp_path / "t"), delimiter="|", compression="gzip")
    assert spark.read.text(str(tmp_path / "t")).first().value == "(1,x)|{2,3}|[k#4.5]|"
    (tmp_path / "h").write_text("g\tr1\tr2\tr1\n\ng2\n")
    assert [tuple(r) for r in fasta.read_hits(spark, str(tmp_path / "h")).collect()] == [("g", ["r1", "r2", "r1"]), ("g2", [])]
    (tmp_path / "n").write_text("10\n5\n")
    assert fasta.read_table(spark, str(tmp_path / "n"), "v int").count() == 2


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\nacgta\n>b\ncgt\n")
    counts = kmer_stream.kmer_counts(kmer_stream.stream_fasta(spark, str(tmp_path / "in")), "seq", 3)
    q = counts.writeStream.outputMode("complete").format("memory").queryName("kc").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert {(r.kmer, r.cnt) for r in spark.table("kc").collect()} == {("acg", 1), ("cgt", 2), ("gta", 1)}
    finally:
        q.stop()


def test_whole_files(spark, tmp_path):
    df = spark.createDataFrame([("a/1", "acgt"), ("b", "gg")], "id string, seq string")
    fasta.write_fasta(df, str(tmp_path / "w"), with_length=True)
    assert {(r.name, r.seq) for r in fasta.read_sequences(spark, str(tmp_path / "w")).collect()} == {("a/1", "acgt"), ("b", "gg")}
    assert fasta.count_sequences(spark, str(tmp_path / "w")) == 2
    assert {r.header for r in fasta.read_fasta(spark, str(tmp_path / "w")).collect()} == {" length=4", " length=2"}
    (tmp_path / "b.fastq").write_text("@x/1\nAC\n+\n!!\n@y\nGT\n+\n!!\n")
    assert fasta.read_fastq_blocks(spark, str(tmp_path / "b.fastq")).selectExpr("sum(size(reads)) as n").first().n == 2


def split(spark, size):
    from contextlib import contextmanager

    @contextmanager
    def small():
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            yield
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    return small()


def test_junk_of_each_file_is_dropped(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.fa").write_text("; a comment line\n" * (i % 2) + f">r{i}\nacgt\n>s{i}\ngg\n" + ">long\n" * (i == 7) + "acgt\n" * 3000 * (i == 7))
    for size in (64 << 20, 2048):
        with split(spark, size):
            df = fasta.read_fasta(spark, str(tmp_path))
            assert df.where("id <> 'long'").count() == 80
            assert {r.id for r in df.collect()} == {f"{c}{i}" for i in range(40) for c in "rs"} | {"long"}


@pytest.mark.parametrize("suffix", ["", ".bz2", ".gz"])
def test_fastq_is_split(spark, tmp_path, suffix):
    import random

    rng = random.Random(1)
    want, text = [], ""
    for i in range(1500):
        n = rng.randint(0, 80)
        seq, quality = "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("@+>!IJ@", k=n))
        end = "\r\n" if i % 3 == 0 else "\n"
        text += f"@r{i}/{i % 2 + 1} x{end}{seq}{end}+{end}{quality}{end}" + "\n" * (i % 50 == 0)
        want.append((f"r{i}", i % 2 + 1, seq.lower()))
    p = tmp_path / f"q.fastq{suffix}"
    {"": open, ".bz2": bz2.open, ".gz": gzip.open}[suffix](p, "wt", newline="").write(text)
    for size in (64 << 20, 4096, 700):
        with split(spark, size):
            df = fasta.read_fastq(spark, str(p))
            if not suffix and size < 5000:
                assert df.rdd.getNumPartitions() > 8
            assert sorted(tuple(r) for r in df.collect()) == sorted(want)
            assert fasta.read_fastq_blocks(spark, str(p)).selectExpr("sum(size(reads)) as n").first().n == 1500


def test_malformed_fastq(spark, tmp_path):
    p = tmp_path / "q.fastq"
    for bad in ("@a\nACGT\n", "@a\nACGT\nxx\n!!!!\n", "@a\nACGT\n+\n!!!!!\n", "ACGT\n+\n!!!!\n@b\nA\n+\n!\n", "@a\nA\n+\n!\nmore\n"):
        p.write_text(bad)
        with pytest.raises(Exception, match="cut off or malformed"):
            fasta.read_fastq(spark, str(p)).collect()


def test_windowed_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("2024-01-01 00:01:00", "acgta"), ("2024-01-01 00:02:00", "cgt"), ("2024-01-01 00:30:00", "acg")], "t string, seq string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    reads = spark.readStream.schema("t timestamp, seq string").json(str(tmp_path / "in"))
    q = kmer_stream.windowed_kmer_counts(reads, "t", "seq", 3).writeStream.outputMode("update").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = {(r.start.minute, r.kmer): r.cnt for r in spark.table("wc").collect()}
        assert got == {(0, "acg"): 1, (0, "cgt"): 2, (0, "gta"): 1, (30, "acg"): 1}
    finally:
        q.stop()

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import codecs, kmers, sequences


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("x")).first().x


def test_pack_golden(spark):
    assert list(one(spark, "attgc", codecs.pack)) == [38, 237]
    assert one(spark, "gmccaam", lambda c: codecs.unpack(codecs.pack(c))) == "gnccaan"
    assert one(spark, "ACGT", lambda c: codecs.unpack(codecs.pack(c))) == "nnnn"
    assert one(spark, None, codecs.pack) is None


@pytest.mark.parametrize("s", ["", "a", "at", "atg", "atgc", "ncagt" * 9, "gatt"])
def test_pack7_bits(spark, s):
    bits = f"{-len(s) % 3:02b}" + "".join(f"{25 * 'atgcn'.index(a) + 5 * 'atgcn'.index(b) + 'atgcn'.index(c) + 1:07b}" for a, b, c in zip(*[iter(s + "n" * (-len(s) % 3))] * 3, strict=True))
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    want = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert bytes(one(spark, s, codecs.pack7)) == want
    assert one(spark, s, lambda c: codecs.unpack7(codecs.pack7(c))) == s


def test_subsequence(spark):
    s = "tgcagcgatt"
    for a, b, want in [(0, 3, "tgc"), (0, 6, "tgcagc"), (0, 2, "tg"), (0, 1, "t"), (3, 6, "agc"), (3, 3, None), (5, 99, None), (-1, 2, None)]:
        assert one(spark, s, lambda c: sequences.subsequence(c, a, b)) == want  # noqa: B023


def test_neighbours_counts(spark):
    for n, d, within, exactly in [(3, 1, 10, 9), (10, 1, 31, 30), (10, 2, 436, 405), (10, 3, 3676, 3240)]:
        s = "atgcatgcat"[:n]
        assert one(spark, s, lambda c: F.size(kmers.neighbours(c, d))) == within  # noqa: B023
        assert one(spark, s, lambda c: F.size(kmers.neighbours(c, d, True))) == exactly  # noqa: B023
    assert one(spark, "at", lambda c: kmers.neighbours(c, 3)) is None
    assert one(spark, "at", lambda c: kmers.neighbours(c, 0)) == ["at"]


READ = "tcgtcgctgaagccttcttcaggtcgaaggcgagcgggatcgcgtccggccgcgggcccctggaccccgcgcccgc"


def test_kmers_forms(spark):
    k = lambda **a: one(spark, READ, lambda c: kmers.kmers(c, 20, **a))
    assert len(READ) == 76 and len(k()) == 57
    ends = k(start=0, num=1, both_ends=True)
    assert ends == ["tcgtcgctgaagccttcttc", "cccctggaccccgcgcccgc"]
    assert k(start=50) == [READ[i : i + 20] for i in range(50, 57)]
    assert k(start=3, num=4) == [READ[i : i + 20] for i in range(3, 7)]
    assert k(start=55, num=9) == [READ[i : i + 20] for i in range(55, 57)]
    assert k(start=-1, num=1, seed=5)[0] in READ
    assert k(start=0, num=50, both_ends=True) == [READ[i : i + 20] for i in [*range(50), *range(7, 57)]]
    assert one(spark, "acgt", lambda c: kmers.kmers(c, 5)) is None
    assert one(spark, "anca", lambda c: kmers.kmers(c, 2)) == ["ca"]
    assert one(spark, "nnnn", lambda c: kmers.kmers(c, 2)) == []
    assert one(spark, None, lambda c: kmers.kmers(c, 2)) is None


def test_stepped_kmers(spark):
    rc = lambda s: s[::-1].translate(str.maketrans("atgc", "tacg"))
    want = {s[i : i + 3] for s in (READ, rc(READ)) for i in range(0, len(READ) - 2, 5)}
    got = one(spark, READ, lambda c: kmers.stepped_kmers(c, 3, 5))
    assert set(got) == want and len(got) == len(want)
    assert one(spark, "acxg", lambda c: kmers.stepped_kmers(c, 2)) is None
    assert one(spark, "acg", lambda c: kmers.stepped_kmers(c, 3, 0, False)) == ["acg"]


def test_hashes(spark):
    def poly(s):
        h = 1125899906842597
        for c in s:
            h = (31 * h + ord(c)) % 2**64
        return h - 2**64 if h >= 2**63 else h

    for s in ["a", READ, "hello é", "z" * 500]:
        assert one(spark, s, sequences.hash_long) == poly(s)
    assert one(spark, "", sequences.hash_long) == 0
    assert one(spark, "hello", sequences.string_hash) == 99162322
    assert one(spark, "polygenelubricants", sequences.string_hash) == -2147483648


def test_small_functions(spark):
    assert one(spark, "atgcn", sequences.reverse_complement) == "ngcat"
    assert one(spark, "atxgcN", sequences.reverse_complement) == "gcat"
    assert one(spark, "ttg", sequences.canonical) == "caa"
    assert one(spark, "tng", sequences.canonical) is None
    with pytest.raises(Exception, match="not a k-mer"):
        one(spark, "tng", lambda c: sequences.canonical(c, strict=True))
    assert one(spark, READ[:16], sequences.identity_hash) == READ[:16] + READ[:16][::-1]
    assert one(spark, "acgt", sequences.identity_hash) is None
    assert one(spark, "acgt", lambda c: sequences.replace_at(c, 1, "n")) == "angt"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("atgcn", max_size=40), min_size=1, max_size=20))
def test_round_trips(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", codecs.unpack(codecs.pack(F.col("s"))).alias("a"), codecs.unpack7(codecs.pack7(F.col("s"))).alias("b")).collect()
    assert all(r.s == r.a == r.b for r in rows)

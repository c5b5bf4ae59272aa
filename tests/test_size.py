"""Steps whose memory or time must not grow faster than the input, over odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import coded
from strandlake.plans import recipes, session

ODD = [None, "", "a", "atgc" * 30, "atgc" * 30, "a" * 200, "atgcn" * 25, "ATGC" + "atgc" * 20, "at\ngc" * 20, "gé" + "ttgca" * 20, "n" * 70, "gattaca" * 40 + "n" + "ccgta" * 30]


def windows(texts, k):
    return Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1) if "n" not in t[i : i + k])


@pytest.mark.parametrize("k", [13, 16, 30, 31, 32, 40, 62])
def test_summed_kmers_over_odd_rows(spark, k):
    df = spark.createDataFrame([(x,) for x in ODD], "seq string").repartition(3)
    want = windows(ODD, k)
    got = coded.summed_kmers(df, F.col("seq"), k).collect()
    assert len(got) == len(want) and {r.kmer: r.cnt for r in got} == want
    assert sorted(r.kmer for r in coded.summed_kmers(df, F.col("seq"), k, "set").collect()) == sorted(want)
    assert {r.cnt: r.n_kmers for r in coded.summed_kmers(df, F.col("seq"), k, "stats").collect()} == Counter(want.values())


@pytest.mark.parametrize("k", [14, 30, 40])
def test_sums_in_small_pieces(monkeypatch, k):
    monkeypatch.setattr(coded, "SORTED", 50)
    rng = np.random.default_rng(k)
    texts = ["".join(rng.choice(list("atgcn"), 400, p=[0.3, 0.3, 0.2, 0.19, 0.01])) for _ in range(8)] * 2 + ["a" * 90_000]
    sums, tasks = coded._Sums(), {}
    for t in texts:
        task, sizes, bases = coded._runs(coded._DIGIT[np.frombuffer(t.encode(), np.uint8)], k, 7)
        for i in range(len(task)):
            lo, hi = coded._from_runs(sizes.slice(i, 1), bases.slice(i, 1), k)
            for x in zip(lo.tolist(), hi.tolist() if hi is not None else [0] * len(lo)):
                assert tasks.setdefault(x, task[i]) == task[i]
        sums.add(*coded._from_runs(sizes, bases, k))
    lo, hi, count = sums.total()
    text = coded._text(lo, hi, k, 4).to_pylist()
    assert len(set(text)) == len(text) and dict(zip(text, count.tolist())) == windows(texts, k)


def test_equal_low_halves_with_several_high_ones(monkeypatch):
    lo, hi = np.array([5, 1, 5, 5, 1, 5, 7]), np.array([2, 9, 1, 2, 9, 1, 3])
    for mixed in (coded._mixed, lambda x: x.astype(np.uint64) * np.uint64(0)):  # the second: all hashes collide
        monkeypatch.setattr(coded, "_mixed", mixed)
        for count, want in ((None, [2, 2, 2, 1]), (np.arange(7), [5, 7, 3, 6])):
            a, b, n = coded._Sums._summed([(lo, hi, count)])
            assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 9, want[0]), (5, 1, want[1]), (5, 2, want[2]), (7, 3, want[3])]


def test_kmers_leave_tasks_as_runs(spark, sf):
    """Before, each window was a row of the shuffle, of some 40 bytes."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "atgc" * 6 + "an").alias("seq"))
    made = coded._dealt_runs(df, F.col("seq"), 30, 4)
    n, size = made.agg(F.sum(F.octet_length("sizes") + F.octet_length("bases")), F.sum(F.octet_length("sizes") / 2)).first()
    total = df.agg(F.sum(F.greatest(F.length("seq") - 29, F.lit(0)))).first()[0]
    assert n < 2 * total and size < total / 3


def test_number_of_tasks_follows_the_input(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    size = session.tasks_for(df, 1000)
    assert size > 200 and session.tasks_for(df.union(df), 1000) >= 2 * size - 1
    assert session.tasks_for(spark.createDataFrame([(1,)], "a int"), 1) >= 4
    assert recipes.FEW == 12


def test_pairs_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """Before, a task's rows grew with the input, as the session's number of tasks held whatever the size."""
    from strandlake.operators import groups

    monkeypatch.setattr(groups, "EACH", 50)
    rows = [(k, v) for k in range(40) for v in (3, 1, 2, 2, k)] + [(50, None), (50, 1), (50, 2), (None, 1), (None, 2), (60, 1), (61, 4), (61, 4)]
    spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = Counter((k, a, b) for k in range(40) for a in (3, 1, 2, 2, k) for b in (3, 1, 2, 2, k) if a < b)
    got = groups.value_pairs(df, "k", "v")
    assert Counter(map(tuple, got.collect())) == want
    got.collect()
    assert session.tasks_for(df, 50) > 4 and "hashpartitioning(key" in (plan := got._jdf.queryExecution().toString()) and f", {session.tasks_for(df, 50)}), REPARTITION_BY_NUM" in plan


def test_groups_stream_through_their_program(spark, monkeypatch):
    """Before, a group's reads and its program's whole output were held in pandas and in strings."""
    from strandlake.operators import external

    monkeypatch.setattr(external.Tool, "run", None)
    monkeypatch.setattr(external, "from_fasta", None)
    monkeypatch.setattr(external, "to_fasta", None)
    same = external.Tool("cat {reads}")
    rows = [("g", "g", 0, "acg"), ("g", "b", 1, "acgta"), ("g", "b", 2, "acgta"), ("g", "a", None, "acgtacg"), (None, "x", 0, "aa"), ("h", "y", 0, ""), ("h", "z", 0, "tt")]
    df = spark.createDataFrame(rows, "k string, id string, d int, seq string")
    got = lambda x: sorted(map(tuple, x.collect()))
    assert got(external.assemble_longest(df, "k", same)) == [("None", "x", "aa"), ("g", "a", "acgtacg"), ("h", "z", "tt")]
    assert got(external.assemble_improved(df, "k", same)) == got(external.assemble_longest(df, "k", same))
    assert [(r.contig, r.header) for r in external.assemble_by_key(df.where("k = 'g'"), "k", same, drop_identical=True).collect()] == [("a", ">g-a numberOfReadsInput=4 "), ("b/1", ">g-b/1 numberOfReadsInput=4 ")]
    assert [r.contig for r in external.assemble_by_key(df.where("k = 'h'"), "k", same).collect()] == ["z", "y"]
    assert [(r.contig, r.header) for r in external.assemble_by_key(df.where("k = 'g'"), "k", same, limit=2).collect()] == [("a", ">g-a numberOfReadsInput=4 limit=2")]
    assert [r.contig for r in external.assemble_by_key(df.where("k = 'g'"), "k", same, keep_top=True).collect()] == ["a"]


def test_profiles_are_dealt_once(spark):
    """Before, k-mers of both strands were rows of three shuffles."""
    from strandlake.operators import profiles

    df = spark.createDataFrame([(i % 9 or None, x) for i, x in enumerate(ODD)], "id int, seq string")
    for k in (1, 4, 6):
        want = Counter()
        for i, x in enumerate(ODD):
            for w, n in windows([x], k).items():
                if set(w) <= set("atgc"):
                    want[i % 9 or None, min(w, w[::-1].translate(str.maketrans("atgc", "tacg")))] += n
        got = profiles.profile(df, "id", "seq", k)
        assert {(r.id, r.kmer): r.cnt for r in got.collect()} == want
        nested = profiles.nested_profile(df, "id", "seq", k)
        assert {(r.id, x.kmer) for r in nested.collect() for x in r.profile} == set(want)
        nested.explain()
        assert nested._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_hash_in_blocks():
    """Before, each character was a step of an interpreted expression."""
    from strandlake.functions.sequences import HASH_START, hash_of

    for text in [*ODD, "日x" * 50, "\U0001f600a"]:
        h = HASH_START
        for c in text or "":
            h = (h * 31 + ord(c)) % 2**64
        want = (h - 2**64 if h >= 2**63 else h) if text else 0
        assert hash_of(text) == hash_of(text, 7) == want

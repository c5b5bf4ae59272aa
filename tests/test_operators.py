import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.operators import external, groups, matching, profiles, relational
from strandlake.plans import recipes


def test_n50(spark):
    df = spark.createDataFrame([(10,), (5,), (10,), (5,), (10,)], "v int")
    assert groups.n50(df, "v", 20).first().n50 == 10
    assert groups.n50(df, "v", 30).first().n50 == 5
    assert groups.n50(df, "v", 40).first().n50 is None
    assert groups.n50(df.limit(0), "v").first().n50 is None


@pytest.mark.parametrize("seqs, want", [(["aaaaaa", "aaaaaa", "cccccc"], "aaaaaa"), (["aaa", "aaaa", "cccccc"], "aaaacc"), (["cccccc", "cccncc", "aaaaaa"], "cccacc"), (["nnt"], "nnt"), (["nn", "nn"], "aa"), (["", ""], "")])
def test_consensus(spark, seqs, want):
    if seqs == ["cccccc", "cccncc", "aaaaaa"]:  # one vote each for c and a at the fourth place: a comes first
        want = "cccacc"
    df = spark.createDataFrame([("k", s) for s in seqs], "k string, s string")
    r = groups.consensus(df, "k", "s").first()
    assert (r.key, r.n, r.seq) == ("k", len(seqs), want)


def test_pair_merge(spark):
    df = spark.createDataFrame([("a", 2, "ggc"), ("a", 1, "att"), ("b", 1, "c")], "id string, d int, s string")
    assert [tuple(r) for r in groups.pair_merge(df, "id", "d", "s").collect()] == [("a", 0, "attcgg")]
    with pytest.raises(Exception, match="exactly two"):
        groups.pair_merge(df, "id", "d", "s", strict=True).collect()


def test_value_pairs(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 3), (1, 2), (2, 5), (2, None), (2, 6), (3, 4)], "k int, v long")
    got = Counter((r.key, r.a, r.b) for r in groups.value_pairs(df, "k", "v").collect())
    assert got == Counter({(1, 1, 3): 2, (1, 1, 2): 1, (1, 2, 3): 2})


def _counts(s, k):
    return Counter(s[i : i + k] for i in range(len(s) - k + 1) if "n" not in s[i : i + k])


def test_distances(spark):
    data = [("x", "atgcatgcaa"), ("y", "ttttgcan"), ("z", "atgcatgcaa")]
    df = spark.createDataFrame(data, "id string, seq string")
    got = {(r.id1, r.id2): r.distance for r in profiles.pairwise_distance(df, "id", "seq", 2).collect()}
    sets = {(r.id1, r.id2): r.distance for r in profiles.pairwise_set_distance(df, "id", "seq", 2).collect()}
    for a, s in data:
        for b, t in data:
            p, q = _counts(s, 2), _counts(t, 2)
            lp, lq = (math.sqrt(sum(v * v for v in x.values())) for x in (p, q))
            want = math.sqrt(sum((p[k] / lp - q[k] / lq) ** 2 for k in {*p, *q}))
            assert abs(got[a, b] - want) < 1e-6
            assert sets[a, b] == len({*p} ^ {*q})


def test_fuzzy_joins_agree(spark):
    a = spark.createDataFrame([(i, s) for i, s in enumerate(["atgca", "atgcc", "ttttt", "atgaa", "ccgca"])], "i int, s string")
    b = spark.createDataFrame([(0, "atgca"), (1, "ttttg")], "j int, t string")
    far = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    want = {(x.i, y.j) for x in a.collect() for y in b.collect() if far(x.s, y.t) <= 2}
    assert {(r.i, r.j) for r in matching.fuzzy_join(a, b, "s", "t", 2).collect()} == want
    assert {(r.i, r.j) for r in matching.seed_join(a, b, "s", "t", 2).collect()} == want


def test_kmer_match_leaves_out_last_windows(spark):
    reads = spark.createDataFrame([("acgtacgtt",)], "s string")
    db = spark.createDataFrame([(1, "acgtaccca"), (2, "cccacgttcc"), (3, "gggggacgt")], "id int, s string")
    assert {r.id for r in matching.kmer_match(reads, db, "s", "id", "s", 4).collect()} == {1, 2}
    assert {r.id for r in matching.kmer_match(reads, db, "s", "id", "s", 4, all_windows=True).collect()} == {1, 2, 3}


def test_screening_and_contigs(spark):
    reads = spark.createDataFrame([(1, "aaaacgtca"), (2, "tttttttt"), (3, "gcgtcatt")], "id int, seq string")
    db = spark.createDataFrame([(7, "ccacgtcagg"), (8, "ttttt")], "id int, seq string")
    assert {r.id for r in recipes.screening(reads, db, "id", "seq", "seq", 5).collect()} == {1, 2, 3}
    assert {r.id for r in recipes.screening(reads, db, "id", "seq", "seq", 5, "t+").collect()} == {1, 3}
    got = {r.contig: r.reads for r in recipes.contig_kmer(db, reads, "id", "seq", "id", "seq", 5).collect()}
    assert got == {7: [1, 3], 8: [2]}


def test_dereplicate(spark):
    s = "atgcatgcatgcatgcatgc"
    rows = [("p", 1, s), ("p", 2, s), ("q", 1, "t" + s[1:]), ("q", 2, s), ("r", 1, s)]
    got = recipes.dereplicate(spark.createDataFrame(rows, "id string, d int, seq string"), "id", "d", "seq", 1).collect()
    assert len(got) == 97 + 97 - 4 and Counter(r.n for r in got) == Counter({1: 186, 2: 4})
    assert sum(r.n for r in got) == 2 * 97


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, b string")
    assert relational.cogroup(a, b, "k").count() == 1
    full = {r.k: (len(r.left_bag), len(r.right_bag)) for r in relational.cogroup(a, b, "k", inner=False).collect()}
    assert full == {1: (1, 2), 2: (1, 0), 3: (0, 1)}
    assert relational.cross(a, b).count() == 6
    bags = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], ["c"])], "k int, x array<int>, y array<string>")
    assert relational.flatten_bags(bags, "x", "y").count() == 4
    assert relational.count_rows(spark.createDataFrame([(1, None), (1, 2)], "k int, v int"), ["k"], "v").first().n == 1
    assert [r.token for r in relational.tokenize(spark.createDataFrame([('a "b", (c)*',)], "t string"), "t").collect()] == ["a", "b", "c"]
    assert relational.project_bag(relational.group(b, []), "bag", "b", "bs").first().bs == ["p", "q", "r"]


CAT = external.Tool("cat {reads}")


def test_assembly_per_group(spark):
    rows = [("g", "1", 1, "acgt"), ("g", "1", 2, "acgtt"), ("h", "2", 0, "aa"), ("h", "3", 0, "aa")]
    df = spark.createDataFrame(rows, "grp string, id string, d int, seq string")
    got = {r.group: (r.contig, r.seq) for r in external.assemble_longest(df, "grp", CAT).collect()}
    assert got == {"g": ("1/2", "acgtt"), "h": ("2", "aa")}
    by = external.assemble_by_key(df, "grp", CAT, drop_identical=True, seeds={"g": "acgt"}).collect()
    assert sorted((r.group, r.seq) for r in by) == [("g", "acgtt"), ("h", "aa")]
    one = external.assemble_by_key(df, "grp", CAT, limit=1).collect()
    assert sorted((r.group, r.contig, r.seq) for r in one) == [("g", "1/1", "acgt"), ("h", "2", "aa")]
    assert one[0].header == f">{one[0].group}-{one[0].contig} numberOfReadsInput=2 limit=1"
    seeded = spark.createDataFrame([("s", "s", 0, "acg"), ("s", "a", 1, "acgtt"), ("s", "b", 1, "ac"), ("s", "c", 1, "acgttt")], "grp string, id string, d int, seq string")
    assert [r.seq for r in external.assemble_by_key(seeded, "grp", CAT, limit=3).collect()] == ["acgtt"]
    assert [r.seq for r in external.assemble_by_key(seeded, "grp", CAT, keep_top=True).collect()] == ["acgttt"]
    assert external.assemble_improved(df, "grp", CAT).count() == 2


def test_external_errors_and_timeout():
    with pytest.raises(external.ToolError):
        external.Tool("false").run({"reads": ""})
    with pytest.raises(external.ToolError):
        external.Tool("sleep 5", timeout=0.2).run({})
    with pytest.raises(external.ToolError):
        external.Tool("no-such-program-here").run({})
    assert external.Tool("true", "{dir}/none", missing_ok=True).run({}) == ""


def test_blast_and_extension(spark, tmp_path):
    script = tmp_path / "hits.sh"
    script.write_text("#!/bin/sh\ngrep '>' \"$1\" | sed 's/>/geneA\\t/'\n")
    tool = external.Tool(f"sh {script} {{reads}}")
    reads = spark.createDataFrame([("r", 1, "acgt"), ("s", 0, "tt")], "id string, d int, seq string")
    hits = external.blast(reads, ">q\nacgt\n", tool)
    assert {(r.geneid, r.id, r.d) for r in hits.collect()} == {("geneA", "r", 1), ("geneA", "s", 0)}
    assert len(external.grouped_hits(hits).first().reads) == 2
    contigs = spark.createDataFrame([("c", "(acg)"), ("e", "acgtacgt")], "grp string, seq string")
    near = spark.createDataFrame([("c", "r", 0, "acgtt")], "grp string, id string, d int, seq string")
    got = {r.group: (r.seq, r.extended) for r in external.extend_contig(contigs, near, "grp", CAT).collect()}
    assert got == {"c": ("acgtt", 1), "e": ("acgtacgt", 0)}
    assert external.scaled_evalue(1.0, 50, 100) == 0.5


def test_blat_finds_reads_outside_the_group(spark, tmp_path):
    script = tmp_path / "blat.py"
    script.write_text(
        "import sys\n"
        "def fa(p): x = open(p).read().split(); return list(zip((i[1:] for i in x[::2]), x[1::2]))\n"
        "for q, s in fa(sys.argv[2]):\n"
        "    for r, t in fa(sys.argv[1]):\n"
        "        if s[:4] in t: print(q, r, sep='\\t')\n"
    )
    tool = external.Tool(f"python3 {script} {{reads}} {{query}}")
    db = spark.createDataFrame([("r", 1, "acgtaa"), ("r", 2, "ggggtt"), ("s", 0, "ttacgt"), ("t", 0, "ccggggcc"), ("u", 0, "ctctct")], "id string, d int, seq string")
    groups = spark.createDataFrame([("g", "r", 1, "acgtaa"), ("h", "u", 0, "ctctct"), ("h", "s", 0, "ttacgt")], "group string, id string, d int, seq string")
    for parts in ({}, {"bases": 9}):  # one part, several parts
        got = {r.group: r.reads for r in external.blat_groups(groups, db, tool, **parts).collect()}
        assert got == {"g": "r/1, r/2, s, t", "h": "s, u"}


def test_blast_runs_once_a_partition_with_its_share_of_the_e_value(spark, tmp_path):
    script = tmp_path / "hits.sh"
    script.write_text("#!/bin/sh\ngrep '>' $1 | sed \"s/>/gene:$2:$3:$(grep -c '>' $1)\\t/\"\n")
    tool = external.Tool(f"sh {script} {{reads}} {{evalue}} {{effective}}")
    reads = spark.createDataFrame([(f"r{i}", 0, "acgt") for i in range(20)] + [("r0", 0, "tttt")], "id string, d int, seq string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            hits = external.blast(reads, ">q\nacgt\n", tool, evalue=2.0, total_bases=168).collect()
            assert {h.geneid for h in hits} == {"gene:1.0:168:21"} and len(hits) == 21
            assert sorted(h.seq for h in hits if h.id == "r0") == ["acgt", "tttt"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "-e {evalue}" in external.TOOLS["blast"].command


def test_tools_from_the_session(spark):
    spark.conf.set("strandlake.cap3.command", "cat {reads}")
    spark.conf.set("strandlake.cap3.output", "{reads}")
    spark.conf.set("strandlake.cap3.timeout", "7")
    try:
        t = external.configured(spark, "cap3")
        assert (t.command, t.output, t.timeout, t.setup) == ("cat {reads}", "{reads}", 7.0, [])
        df = spark.createDataFrame([("g", "1", 1, "acgt")], "grp string, id string, d int, seq string")
        assert external.assemble_by_key(df, "grp", "cap3").first().seq == "acgt"
    finally:
        for k in ("command", "output", "timeout"):
            spark.conf.unset(f"strandlake.cap3.{k}")
    assert external.configured(spark, "velvet") == external.TOOLS["velvet"]


def test_stream_through(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a c")], "k int, v string")
    assert sorted(tuple(r) for r in external.stream_through(df, "sed s/a/x/", "k int, v string").collect()) == [(1, "b"), (2, ""), (3, "x c")]
    with pytest.raises(Exception, match="ended with"):
        external.stream_through(df, "false", "k int").collect()


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x")] * 300 + [(2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "k int, b string")
    assert relational.skewed_join(a, b, "k").count() == relational.merge_join(a, b, "k", 3).count() == 600
    count = lambda how: relational.join(a, b, ["k"], how).count()
    assert [count(h) for h in ("inner", "left", "right", "full", "semi", "anti")] == [600, 602, 602, 604, 300, 2]
    x, y = spark.createDataFrame([(1,), (1,), (2,)], "v int"), spark.createDataFrame([(1,), (3,)], "v int")
    assert (relational.intersect(x, y).count(), relational.difference(x, y).count(), relational.difference(x, y, all=True).count()) == (1, 1, 2)
    kept = {r.v for r in relational.sample(spark.range(4000).withColumnRenamed("id", "v"), 0.25, by="v").collect()}
    assert 800 < len(kept) < 1200 and kept == {r.v for r in relational.sample(spark.range(4000).withColumnRenamed("id", "v"), 0.25, by="v").collect()}


def test_seed_join_keeps_repeats(spark):
    a = spark.createDataFrame([("atgca",), ("atgca",)], "s string")
    b = spark.createDataFrame([("atgcc",), ("atgca",)], "t string")
    assert Counter(map(tuple, matching.seed_join(a, b, "s", "t", 2).collect())) == Counter(map(tuple, matching.fuzzy_join(a, b, "s", "t", 2).collect())) == {("atgca", "atgcc"): 2, ("atgca", "atgca"): 2}


def test_coded_kmers_against_plain_windows(spark):
    import random

    from strandlake.operators import coded

    rng = random.Random(4)
    seqs = ["".join(rng.choices("atgc", k=n)) for n in (0, 3, 5, 70, 4000)] + ["".join(rng.choices("atgcn", k=300)), "acgtNNacgtacxgtacgé日acgtacgta", "acgtacgt", None, "n" * 9]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    old, coded.STRETCH = coded.STRETCH, 64  # so that sequences are cut
    try:
        for k in (1, 2, 5, 27, 28, 31, 32, 40, 62):
            for n_too in (False, True):
                if k > 2 * coded.per_long(n_too):
                    continue
                want = Counter((i, s[j : j + k]) for i, s in enumerate(seqs) if s for j in range(len(s) - k + 1) if n_too or "n" not in s[j : j + k])
                if k in (5, 31, 40):
                    got = coded.kmer_counts(df, ["id"], F.col("seq"), k, n_too).groupBy("id", *coded.KMER).agg(F.sum("cnt").alias("cnt"))
                    assert {(r.id, r.kmer): r.cnt for r in got.select("id", coded.text_of(k, n_too).alias("kmer"), "cnt").collect()} == want
                local = Counter()
                for row, hi, lo, other in coded._batch(seqs, k, n_too):
                    for n, (r, h, x) in enumerate(zip(row.tolist(), hi.tolist(), lo.tolist(), strict=True)):
                        local[r, h, x, other[n] if other else ""] += 1
                assert sorted(local.values()) == sorted(want.values())
    finally:
        coded.STRETCH = old


def test_chunks_hold_each_window_once(spark):
    from strandlake.functions.kmers import chunks, windows

    s = "".join("acgt"[i * i % 4] for i in range(997)) + "tgca" * 50
    df = spark.createDataFrame([(s,), ("acg",), (None,), ("acgta",)], "s string")
    for size in (7, 100, 5000):
        got = df.select(F.explode(chunks(F.col("s"), 5, size)).alias("c")).select(F.explode(windows(F.col("c"), 5)).alias("w")).collect()
        assert Counter(r.w for r in got) == Counter([s[i : i + 5] for i in range(len(s) - 4)] + ["acgta"])


def test_stepped_numbers_against_text(spark):
    from strandlake.functions.kmers import stepped_kmers
    from strandlake.operators import coded

    rows = [(1, "acgtnacgtacca" * 30), (2, "acg"), (3, None), (4, "acgxtacgta"), (5, "ttttttttttt"), (6, "")]
    df = spark.createDataFrame(rows, "id int, seq string")
    old, coded.STRETCH = coded.STRETCH, 50
    try:
        for k, step, both in ((4, 3, True), (5, 1, False), (3, 7, True)):
            got = coded.stepped_kmers(df, ["id"], F.col("seq"), k, step, both).select("id", coded.text_of(k, True).alias("kmer")).collect()
            want = df.select("id", F.explode(stepped_kmers(F.col("seq"), k, step, both)).alias("kmer")).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    finally:
        coded.STRETCH = old

"""Queries over the driver's tables, one or more for each operator, with SQL for comparison.

The tables hold no nucleotides; ``from_text`` folds any text onto the alphabet in the same
way in both engines. Documents are reads, benchmark items are contigs or a database,
conversation turns are mates, line items are groups of values. All rows and whole texts
are used.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import codecs, kmers, sequences, sql
from strandlake.operators import coded, external, groups, matching, profiles, relational
from strandlake.plans import recipes
from strandlake.plans.session import Workspace, table
from strandlake.sources import fasta
from strandlake.streaming import kmer_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SEQ = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'atgcatgcatgcatgcatgcatgcan')"
_READS = f"WITH r AS (SELECT doc_id AS id, {_SEQ} AS seq FROM documents)"
_DB = f"b AS (SELECT item_id AS id, {_SEQ} AS seq FROM benchmark)"


def _windows(source: str, k: int, name: str, n_too: bool = False, short: int = 0) -> str:
    """SQL: (id, i, kmer) of all windows of ``source``; windows with n are left out unless ``n_too``.

    Sequences are first cut into overlapping parts of 500 windows, so that the work stays linear.
    """
    keep = "" if n_too else " WHERE NOT contains(kmer, 'n')"
    parts = f"SELECT id, c, substr(seq, c * 500 + 1, 500 + {k} - 1) AS s FROM (SELECT id, substr(seq, 1, greatest(length(seq) - {short}, 0)) AS seq, unnest(range(0, length(seq) // 500 + 1)) AS c FROM {source})"
    rows = f"SELECT id, c, s, unnest(range(1, least(500, length(s) - {k} + 1) + 1)) AS o FROM ({parts})"
    return f"{name} AS (SELECT id, i, kmer FROM (SELECT id, c * 500 + o AS i, substr(s, o, {k}) AS kmer FROM ({rows})){keep})"


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sequences.from_text(F.col("text")).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), sequences.from_text(F.col("text")).alias("seq"))


# --- k-mers -----------------------------------------------------------------------


@query(f"{_READS}, {_windows('r', 30, 'k')} SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer")
def kmer_count(spark, sf_dir):
    return recipes.kmer_count(reads(spark, sf_dir), "seq", 30)


@query(f"{_READS}, {_windows('r', 30, 'k')} SELECT cnt, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer) GROUP BY cnt")
def kmer_stats(spark, sf_dir):
    return recipes.kmer_stats(reads(spark, sf_dir), "seq", 30)


@query(f"{_READS}, {_windows('r', 40, 'k')} SELECT DISTINCT kmer FROM k")
def kmer_distinct(spark, sf_dir):
    return recipes.kmer_set(reads(spark, sf_dir), "seq", 40)


@query(f"{_READS}, {_windows('r', 8, 'k')} SELECT id, kmer, count(*) AS cnt FROM k WHERE i > 3 AND i <= 23 GROUP BY id, kmer")
def kmer_window(spark, sf_dir):
    e = reads(spark, sf_dir).select("id", F.explode(kmers.kmers(F.col("seq"), 8, 3, 20)).alias("kmer"))
    return e.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    f"""{_READS}, {_windows('r', 20, 'k')}, n AS (SELECT id, length(seq) AS n FROM r), e AS (
  SELECT k.id, kmer FROM k WHERE i <= 10
  UNION ALL SELECT k.id, kmer FROM k JOIN n USING (id) WHERE i > greatest(n - 20 - 10 + 1, 0))
SELECT id, kmer, count(*) AS cnt FROM e GROUP BY id, kmer"""
)
def kmer_both_ends(spark, sf_dir):
    e = reads(spark, sf_dir).select("id", F.explode(kmers.kmers(F.col("seq"), 20, 0, 10, both_ends=True)).alias("kmer"))
    return e.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    f"""{_READS}, c AS (SELECT id, reverse(translate(seq, 'atgc', 'tacg')) AS seq FROM r),
{_windows('r', 12, 'f', True)}, {_windows('c', 12, 'g', True)},
e AS (SELECT id, kmer FROM f WHERE (i - 1) % 3 = 0 UNION SELECT id, kmer FROM g WHERE (i - 1) % 3 = 0)
SELECT kmer, count(*) AS n_reads FROM e GROUP BY kmer"""
)
def kmer_step_revcomp(spark, sf_dir):
    e = coded.stepped_kmers(reads(spark, sf_dir), [], F.col("seq"), 12, 3)
    return e.groupBy(*coded.KMER).agg(F.count(F.lit(1)).alias("n_reads")).select(coded.text_of(12, True).alias("kmer"), "n_reads")


@query(f"{_READS}, {_windows('r', 6, 'k')} SELECT least(kmer, reverse(translate(kmer, 'atgc', 'tacg'))) AS kmer, count(*) AS cnt FROM k GROUP BY 1")
def canonical_kmer_count(spark, sf_dir):
    return recipes.kmer_count(reads(spark, sf_dir), "seq", 6).groupBy(sequences.canonical(F.col("kmer"), strict=True).alias("kmer")).agg(F.sum("cnt").alias("cnt"))


# --- profiles and distances -------------------------------------------------------

_PROFILE = f"""{_READS}, {_windows('r', 4, 'k')}, c AS (SELECT id, least(kmer, reverse(translate(kmer, 'atgc', 'tacg'))) AS kmer, count(*) AS cnt FROM k GROUP BY 1, 2),
p AS (SELECT id, kmer, cnt, sqrt(sum(cnt * cnt) OVER (PARTITION BY id)) AS length FROM c)"""


@query(f"{_PROFILE} SELECT id, kmer, cnt, round(length, 6) AS length, round(cnt / length, 9) AS normlen FROM p")
def kmer_profile(spark, sf_dir):
    p = recipes.kmer_profile(reads(spark, sf_dir), "id", "seq", 4)
    return p.select("id", "kmer", "cnt", F.round("length", 6).alias("length"), F.round("normlen", 9).alias("normlen"))


@query(f"{_PROFILE} SELECT id, round(min(length), 6) AS length, count(*) AS n_kmers, string_agg(kmer, ',' ORDER BY kmer) AS kmers FROM p GROUP BY id")
def nested_profile(spark, sf_dir):
    p = profiles.nested_profile(reads(spark, sf_dir), "id", "seq", 4)
    return p.select("id", F.round("length", 6).alias("length"), F.size("profile").cast("long").alias("n_kmers"), F.array_join(F.transform("profile", lambda x: x["kmer"]), ",").alias("kmers"))


@query(
    f"""WITH {_DB}, {_windows('b', 3, 'k')}, c AS (SELECT id, kmer, count(*) AS cnt FROM k GROUP BY 1, 2),
s AS (SELECT id, sqrt(sum(cnt * cnt)) AS len FROM c GROUP BY id),
d AS (SELECT x.id AS id1, y.id AS id2, sum(x.cnt * y.cnt) AS dot FROM c x JOIN c y USING (kmer) GROUP BY 1, 2)
SELECT s1.id AS id1, s2.id AS id2, round(sqrt(greatest(0.0, 2 - 2 * coalesce(dot, 0) / (s1.len * s2.len))), 6) AS distance
FROM s s1 CROSS JOIN s s2 LEFT JOIN d ON d.id1 = s1.id AND d.id2 = s2.id"""
)
def tnf_distance(spark, sf_dir):
    d = recipes.tetranucleotide_distance(contigs(spark, sf_dir), "id", "seq", 3)
    return d.select("id1", "id2", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_DB}, {_windows('b', 4, 'k')}, c AS (SELECT DISTINCT id, kmer FROM k), s AS (SELECT id, count(*) AS n FROM c GROUP BY id),
d AS (SELECT x.id AS id1, y.id AS id2, count(*) AS shared FROM c x JOIN c y USING (kmer) GROUP BY 1, 2)
SELECT s1.id AS id1, s2.id AS id2, s1.n + s2.n - 2 * coalesce(shared, 0) AS distance FROM s s1 CROSS JOIN s s2 LEFT JOIN d ON d.id1 = s1.id AND d.id2 = s2.id"""
)
def set_distance(spark, sf_dir):
    return recipes.set_distance(contigs(spark, sf_dir), "id", "seq", 4)


@query(
    """WITH n AS (SELECT l_suppkey AS key, l_quantity AS a, l_discount AS b, sqrt(sum(l_quantity * l_quantity) OVER w) AS la, sqrt(sum(l_discount * l_discount) OVER w) AS lb
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT key, round(sqrt(sum(pow(a / CASE WHEN la = 0 THEN 1 ELSE la END - b / CASE WHEN lb = 0 THEN 1 ELSE lb END, 2))), 6) AS distance FROM n GROUP BY key"""
)
def vector_distance(spark, sf_dir):
    d = profiles.vector_distance(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_discount")
    return d.select("key", F.round("distance", 6).alias("distance"))


@query("SELECT l_partkey AS key, round(sqrt(sum(l_quantity * l_quantity)), 6) AS length FROM lineitem GROUP BY 1")
def norm_length(spark, sf_dir):
    d = profiles.norm_length(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")
    return d.select("key", F.round("length", 6).alias("length"))


# --- groups -----------------------------------------------------------------------


@query("WITH s AS (SELECT n_chars AS v, sum(n_chars) OVER (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT max(v) FILTER (run > (SELECT sum(n_chars) // 2 FROM documents)) AS n50 FROM s")
def n50(spark, sf_dir):
    return recipes.n50(table(spark, sf_dir, "documents"), "n_chars")


@query(
    f"""WITH r AS (SELECT source AS key, {_SEQ} AS seq FROM documents),
s AS (SELECT key, count(*) AS n, min(seq) AS single FROM r GROUP BY key),
c AS (SELECT key, i, ch FROM (SELECT key, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS i FROM r WHERE seq <> '')),
v AS (SELECT key, i, count(*) FILTER (ch = 'a') AS a, count(*) FILTER (ch = 't') AS t, count(*) FILTER (ch = 'g') AS g, count(*) FILTER (ch = 'c') AS c FROM c GROUP BY 1, 2),
m AS (SELECT key, string_agg(CASE greatest(a, t, g, c) WHEN a THEN 'a' WHEN t THEN 't' WHEN g THEN 'g' ELSE 'c' END, '' ORDER BY i) AS merged FROM v GROUP BY key)
SELECT s.key, s.n, CASE WHEN s.n = 1 THEN single ELSE coalesce(merged, '') END AS seq FROM s LEFT JOIN m ON s.key = m.key"""
)
def consensus(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("source", sequences.from_text(F.col("text")).alias("seq"))
    return groups.consensus(r, "source", "seq")


_MATES = f"m AS (SELECT conv_id AS id, turn, {_SEQ} AS seq FROM conversations), p AS (SELECT id, min_by(seq, turn) || reverse(max_by(seq, turn)) AS seq FROM m GROUP BY id HAVING count(*) = 2)"


def _mates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sequences.from_text(F.col("text")).alias("seq"))


@query(f"WITH {_MATES} SELECT id, 0 AS d, seq FROM p")
def pair_merge(spark, sf_dir):
    return groups.pair_merge(_mates(spark, sf_dir), "conv_id", "turn", "seq")


@query("SELECT x.l_orderkey AS key, x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey")
def read_pairs(spark, sf_dir):
    return groups.value_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT conv_id AS key, string_agg(role, chr(9) ORDER BY role) AS values FROM conversations GROUP BY conv_id")
def joined_values(spark, sf_dir):
    return groups.joined_values(table(spark, sf_dir, "conversations"), "conv_id", "role")


# Programs that stand in for the usual ones: they keep the contract of files and output, and their results have SQL.
_SORTED = "paste - - < {} | LC_ALL=C sort -k2 | tr '\\t' '\\n'"


def _shell(command: str, **args) -> external.Tool:
    return external.Tool("sh -c " + shlex.quote(command), **args)


SORTING = {
    "cap3": _shell(_SORTED.format("{reads}") + " > {reads}.cap.contigs", output="{reads}.cap.contigs"),
    "velvet": _shell(_SORTED.format("{dir}/v/in") + " > {dir}/v/contigs.fa", output="{dir}/v/contigs.fa", setup=["mkdir {dir}/v", "cp {reads} {dir}/v/in"], missing_ok=True),
    "minimus": _shell(_SORTED.format("{dir}/m.afg") + " > {dir}/m.fasta", output="{dir}/m.fasta", setup=["cp {reads} {dir}/m.afg"], missing_ok=True),
}
JOINING = _shell("mkdir -p {dir}/n; (echo '>all'; grep -v '>' {reads} | LC_ALL=C sort | tr -d '\\n'; echo; cat {reads}) > {dir}/n/454AllContigs.fna", output="{dir}/n/454AllContigs.fna", missing_ok=True)
FINDING = _shell("""paste - - < {query} | while read h s; do paste - - < {reads} | grep -F $s | cut -f1 | sed "s/^>/$h\\t/;s/^>//"; done""")
CONTAINING = _shell("""paste - - < {query} | cut -f2 | grep . > pat; paste - - < {reads} | grep -F -f pat | cut -f1 | sed "s/^>/q\\t/" """)
GENES = {"geneA": "gcatgcatt", "geneB": "ttgcaag"}
GENE_TEXT = "".join(f">{n}\n{s}\n" for n, s in GENES.items())
_GENES = "genes(gene, motif) AS (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in GENES.items()) + ")"


def _longest(source: str) -> str:
    """SQL: the longest seq of each key of ``source`` (key, seq), the first of equal ones."""
    return f"SELECT key, min(seq) FILTER (length(seq) = m) AS seq FROM (SELECT key, seq, max(length(seq)) OVER (PARTITION BY key) AS m FROM {source}) GROUP BY key"


def _by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("d"), sequences.from_text(F.col("text")).alias("seq"))


_SOURCES = f"WITH r AS (SELECT source AS key, {_SEQ} AS seq FROM documents)"


@query(f"{_SOURCES}, b AS ({_longest('r')}) SELECT key AS \"group\", seq FROM b")
def assemble_velvet(spark, sf_dir):
    return external.assemble_longest(_by_source(spark, sf_dir), "source", SORTING["velvet"]).select("group", "seq")


@query(f"{_SOURCES}, b AS ({_longest('r')}) SELECT key AS \"group\", seq FROM b")
def assemble_cap3(spark, sf_dir):
    return external.assemble_longest(_by_source(spark, sf_dir), "source", SORTING["cap3"]).select("group", "seq")


@query(f"{_SOURCES}, b AS ({_longest('r')}) SELECT key AS \"group\", seq FROM b")
def assemble_minimus(spark, sf_dir):
    return external.assemble_by_key(_by_source(spark, sf_dir), "source", SORTING["minimus"], keep_top=True).select("group", "seq")


@query(
    f"""WITH r AS (SELECT item_id % 10 AS key, {_SEQ} AS seq FROM benchmark),
b AS (SELECT key, string_agg(seq, '' ORDER BY seq) AS whole FROM r GROUP BY key)
SELECT key::VARCHAR AS "group", 'all' AS contig, whole AS seq FROM b"""
)
def assemble_newbler(spark, sf_dir):
    r = contigs(spark, sf_dir).select((F.col("id") % 10).alias("key"), F.col("id").cast("string").alias("id"), F.lit(0).alias("d"), "seq")
    return external.assemble_improved(r, "key", JOINING)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("int").alias("d"), "role", sequences.from_text(F.col("text")).alias("seq"))


_TURNS = f"t AS (SELECT conv_id::VARCHAR AS id, turn AS d, role, {_SEQ} AS seq FROM conversations)"


@query(
    f"""WITH {_TURNS}, u AS (SELECT DISTINCT ON (role, seq) *, CASE WHEN d = 0 THEN id ELSE id || '/' || d END AS name FROM t ORDER BY role, seq, id, d),
k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id, d, seq) AS place FROM u),
b AS (SELECT role, max_by(seq, (length(seq), -rank)) AS seq, max_by(name, (length(seq), -rank)) AS name FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY name) AS rank FROM k WHERE place <= 50) GROUP BY role),
n AS (SELECT role, count(*) AS n FROM t GROUP BY role)
SELECT role AS "group", name AS contig, seq, '>' || role || '-' || name || ' numberOfReadsInput=' || n || ' ' || CASE WHEN n > 50 THEN 'limit=50' ELSE '' END AS header FROM b JOIN n USING (role)"""
)
def group_assembly(spark, sf_dir):
    return external.assemble_by_key(_turns(spark, sf_dir), "role", SORTING["cap3"], keep_top=True, drop_identical=True, limit=50)


@query(f"WITH {_TURNS}, {_GENES} SELECT gene AS geneid, id, d, seq FROM genes JOIN t ON contains(seq, motif)")
def blast_hits(spark, sf_dir):
    h = external.blast(_turns(spark, sf_dir), GENE_TEXT, FINDING)
    return h.select("geneid", "id", F.col("d").cast("long").alias("d"), "seq")


@query(f"WITH {_TURNS}, {_GENES}, r AS (SELECT DISTINCT gene AS key, t.id, t.d, t.seq FROM genes JOIN t h ON contains(h.seq, motif) JOIN t ON t.id = h.id), b AS ({_longest('r')}) SELECT key AS \"group\", seq FROM b")
def gene_assembly(spark, sf_dir):
    return recipes.gene_assembly(_turns(spark, sf_dir), GENE_TEXT, FINDING, SORTING["velvet"]).select("group", "seq")


@query(f"WITH {_DB}, h AS (SELECT DISTINCT (q.id % 10)::VARCHAR AS \"group\", d.id::VARCHAR AS hit FROM b q JOIN b d ON q.seq <> '' AND contains(d.seq, q.seq)) SELECT \"group\", string_agg(hit, ', ' ORDER BY hit) AS reads FROM h GROUP BY 1")
def blat_hits(spark, sf_dir):
    db = contigs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("d"), "seq")
    g = contigs(spark, sf_dir).select((F.col("id") % 10).cast("string").alias("group"), F.col("id").cast("string").alias("id"))
    return external.blat_groups(g, db, CONTAINING)


@query(
    f"""{_READS}, {_DB}, {_windows('r', 20, 'k')}, {_windows('b', 20, 'd')}, n AS (SELECT id, length(seq) AS n FROM b),
e AS (SELECT DISTINCT d.id, kmer FROM d JOIN n USING (id) WHERE i <= 10 OR i > greatest(n - 20 - 10 + 1, 0)),
p AS (SELECT DISTINCT e.id AS contig, k.id AS read FROM e JOIN k USING (kmer)),
l AS (SELECT contig AS key, r.seq FROM p JOIN r ON p.read = r.id), m AS ({_longest('l')})
SELECT b.id::VARCHAR AS "group", CASE WHEN length(m.seq) > length(b.seq) THEN m.seq ELSE b.seq END AS seq, coalesce((length(m.seq) > length(b.seq))::INT, 0) AS extended FROM b LEFT JOIN m ON m.key = b.id"""
)
def contig_extension(spark, sf_dir):
    return recipes.extend_contigs(contigs(spark, sf_dir), reads(spark, sf_dir), "id", "seq", "id", "seq", 20, 10, SORTING["cap3"])


# --- scalar functions -------------------------------------------------------------


@query(f"{_READS} SELECT id, CASE WHEN length(seq) >= 45 THEN substr(seq, 11, 35) END AS part FROM r")
def subsequence(spark, sf_dir):
    return reads(spark, sf_dir).select("id", sequences.subsequence(F.col("seq"), 10, 45).alias("part"))


@query(f"{_READS} SELECT id, CASE WHEN length(seq) >= 16 THEN substr(seq, 1, 16) || substr(reverse(seq), 1, 16) END AS hash FROM r")
def identity_hash(spark, sf_dir):
    return reads(spark, sf_dir).select("id", sequences.identity_hash(F.col("seq")).alias("hash"))


_POLY = "list_reduce(list_transform(string_split(seq, ''), lambda c: ascii(c)::HUGEINT), lambda h, c: (h * 31 + c) % 18446744073709551616::HUGEINT, 1125899906842597::HUGEINT)"


@query(f"{_READS}, h AS (SELECT id, CASE WHEN seq = '' THEN 0::HUGEINT ELSE {_POLY} END AS h FROM r) SELECT id, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash FROM h")
def hash_long(spark, sf_dir):
    return reads(spark, sf_dir).select("id", sequences.hash_long(F.col("seq")).alias("hash"))


@query(
    """WITH h AS (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS h FROM customer)
SELECT c_custkey, (CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END)::INTEGER AS hash FROM h"""
)
def string_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sequences.string_hash(F.col("c_name")).alias("hash"))


@query(f"{_READS} SELECT id, reverse(translate(seq, 'atgc', 'tacg')) AS rc FROM r")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("id", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query(f"{_READS} SELECT id, length(seq) AS n, CASE WHEN length(seq) > 4 THEN substr(seq, 1, 4) || 'n' || substr(seq, 6) ELSE seq END AS changed, contains(seq, 'nn') AS has_nn FROM r")
def sequence_helpers(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).select("id", sequences.num_bases(s).cast("long").alias("n"), F.when(F.length(s) > 4, sequences.replace_at(s, 4, "n")).otherwise(s).alias("changed"), F.contains(s, F.lit("nn")).alias("has_nn"))


@query(
    f"""WITH {_DB}, g AS (SELECT id, i, substr(seq, i, 3) AS g FROM b, unnest(range(1, length(seq) + 1, 3)) u(i)),
x AS (SELECT id, i, length(g) AS n, instr('atgcn', substr(g, 1, 1)) - 1 AS p, instr('atgcn', substr(g, 2, 1)) - 1 AS q, instr('atgcn', substr(g, 3, 1)) - 1 AS r FROM g)
SELECT id, string_agg(printf('%02X', (CASE n WHEN 3 THEN 32 + 25 * p + 5 * q + r WHEN 2 THEN 224 + 5 * p + q ELSE 160 + p END)::INTEGER), '' ORDER BY i) AS packed FROM x GROUP BY id"""
)
def pack_hex(spark, sf_dir):
    return contigs(spark, sf_dir).select("id", F.hex(codecs.pack(F.col("seq"))).alias("packed"))


@query(f"{_READS} SELECT id, seq, ceil(length(seq) / 3.0)::BIGINT AS n_bytes FROM r")
def pack_round_trip(spark, sf_dir):
    p = reads(spark, sf_dir).select("id", codecs.pack(F.col("seq")).alias("p"), codecs.packed_size(F.col("seq")).alias("n_bytes"))
    return p.select("id", codecs.unpack(F.col("p")).alias("seq"), F.octet_length("p").cast("long").alias("n_bytes"))


@query(f"{_READS} SELECT id, seq, ceil((2 + ceil(length(seq) / 3.0) * 7) / 8)::BIGINT AS n_bytes FROM r")
def pack7_round_trip(spark, sf_dir):
    p = reads(spark, sf_dir).select("id", codecs.pack7(F.col("seq")).alias("p"))
    return p.select("id", codecs.unpack7(F.col("p")).alias("seq"), F.octet_length("p").cast("long").alias("n_bytes"))


# --- matching ---------------------------------------------------------------------

_BASES = "(VALUES ('a'), ('t'), ('g'), ('c')) z(ch)"
_CODES = "code AS (SELECT id, substr(seq, 1, 10) AS s FROM b WHERE length(seq) >= 10)"
_NEAR2 = f"""n1 AS (SELECT DISTINCT id, substr(s, 1, i - 1) || ch || substr(s, i + 1) AS s FROM code, unnest(range(1, 11)) u(i), {_BASES}),
n2 AS (SELECT DISTINCT id, substr(s, 1, i - 1) || ch || substr(s, i + 1) AS s FROM n1, unnest(range(1, 11)) u(i), {_BASES}),
near AS (SELECT id, s FROM code UNION SELECT id, s FROM n1 UNION SELECT id, s FROM n2)"""


def _codes(spark, sf_dir):
    return contigs(spark, sf_dir).select("id", sequences.subsequence(F.col("seq"), 0, 10).alias("code")).where("code is not null")


@query(f"WITH {_DB}, {_CODES}, {_NEAR2} SELECT id, s AS near FROM near")
def hamming_neighbours(spark, sf_dir):
    return _codes(spark, sf_dir).select("id", F.explode(kmers.neighbours(F.col("code"), 2)).alias("near"))


@query(f"WITH {_DB}, {_CODES}, {_NEAR2} SELECT near.id, near.s AS near FROM near JOIN code ON code.id = near.id AND hamming(code.s, near.s) = 2")
def hamming_exactly(spark, sf_dir):
    return _codes(spark, sf_dir).select("id", F.explode(kmers.neighbours(F.col("code"), 2, exactly=True)).alias("near"))


@query(f"{_READS}, {_DB}, {_CODES}, {_NEAR2} SELECT near.id AS barcode, r.id AS read FROM near JOIN r ON length(r.seq) >= 10 AND substr(r.seq, 1, 10) = near.s")
def barcode_assign(spark, sf_dir):
    return recipes.assign_barcodes(reads(spark, sf_dir), _codes(spark, sf_dir), "id", "seq", "id", "code", 10, 2)


@query(f"{_READS}, {_DB}, {_CODES}, s AS (SELECT id, substr(seq, 1, 10) AS s FROM r WHERE length(seq) >= 10) SELECT code.id AS barcode, s.id AS read FROM code JOIN s ON hamming(code.s, s.s) <= 3")
def seed_join(spark, sf_dir):
    r = reads(spark, sf_dir).select(F.col("id").alias("read"), sequences.subsequence(F.col("seq"), 0, 10).alias("start")).where("start is not null")
    return matching.seed_join(r, _codes(spark, sf_dir).withColumnRenamed("id", "barcode"), "start", "code", 3).select("barcode", "read")


@query(
    f"""WITH {_MATES}, h AS (SELECT substr(seq, 1, 16) || substr(reverse(seq), 1, 16) AS h, seq FROM p WHERE length(seq) >= 16),
e AS (SELECT h AS hash, seq FROM h UNION ALL SELECT substr(h, 1, i - 1) || ch || substr(h, i + 1), seq FROM h, unnest(range(1, 33)) u(i), {_BASES} WHERE ch <> substr(h, i, 1)),
s AS (SELECT hash AS key, count(*) AS n, min(seq) AS single FROM e GROUP BY hash), r AS (SELECT hash AS key, seq FROM e SEMI JOIN s ON e.hash = s.key AND s.n > 1),
c AS (SELECT key, i, ch FROM (SELECT key, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS i FROM r WHERE seq <> '')),
v AS (SELECT key, i, count(*) FILTER (ch = 'a') AS a, count(*) FILTER (ch = 't') AS t, count(*) FILTER (ch = 'g') AS g, count(*) FILTER (ch = 'c') AS c FROM c GROUP BY 1, 2),
w AS (SELECT key, string_agg(CASE greatest(a, t, g, c) WHEN a THEN 'a' WHEN t THEN 't' WHEN g THEN 'g' ELSE 'c' END, '' ORDER BY i) AS merged FROM v GROUP BY key)
SELECT s.key AS hash, s.n, CASE WHEN s.n = 1 THEN single ELSE coalesce(merged, '') END AS seq FROM s LEFT JOIN w ON s.key = w.key"""
)
def dereplicate(spark, sf_dir):
    return recipes.dereplicate(_mates(spark, sf_dir), "conv_id", "turn", "seq", 1)


@query(f"{_READS}, {_DB}, {_windows('r', 30, 'k')}, {_windows('b', 30, 'd')} SELECT DISTINCT id FROM k WHERE kmer IN (SELECT kmer FROM d WHERE NOT regexp_full_match(kmer, '(a|t)+'))")
def screening(spark, sf_dir):
    return recipes.screening(reads(spark, sf_dir), contigs(spark, sf_dir), "id", "seq", "seq", 30, "(a|t)+")


@query(f"{_READS}, {_DB}, {_windows('r', 30, 'k')}, {_windows('b', 30, 'd')}, p AS (SELECT DISTINCT d.id AS contig, k.id AS read FROM k JOIN d USING (kmer)) SELECT contig, count(*) AS n_reads, string_agg(read::VARCHAR, ',' ORDER BY read) AS reads FROM p GROUP BY contig")
def contig_kmer(spark, sf_dir):
    c = recipes.contig_kmer(contigs(spark, sf_dir), reads(spark, sf_dir), "id", "seq", "id", "seq", 30)
    return c.select("contig", F.size("reads").cast("long").alias("n_reads"), F.array_join(F.transform("reads", lambda x: x.cast("string")), ",").alias("reads"))


@query(f"{_READS}, {_DB}, {_windows('r', 20, 'k', True, 2)}, {_windows('b', 20, 'd', True, 2)} SELECT DISTINCT id FROM d WHERE kmer IN (SELECT kmer FROM k)")
def kmer_match(spark, sf_dir):
    return matching.kmer_match(reads(spark, sf_dir), contigs(spark, sf_dir), "seq", "id", "seq", 20)


# --- sources and sinks ------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return Workspace(spark, name).path("files")


@query(f"{_READS} SELECT id::VARCHAR AS id, 0 AS d, seq, ' len=' || length(seq) AS header FROM r")
def fasta_round_trip(spark, sf_dir):
    path = _scratch(spark, "fasta")
    r = reads(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit(" len="), F.length("seq")).alias("id"), "seq")
    fasta.write_fasta(r, path, compression="bzip2")
    return fasta.read_fasta(spark, path)


def _fastq(spark, sf_dir, **options) -> str:
    path = _scratch(spark, "fastq")
    s = F.upper("seq")
    r = reads(spark, sf_dir).select(F.concat(F.lit("@"), F.col("id"), F.lit("/"), 1 + F.col("id") % 2, F.lit("\n"), s, F.lit("\n+\n"), F.repeat(F.lit("@"), F.length(s))).alias("value"))
    r.write.text(path, **options)
    return path


@query(f"{_READS} SELECT id::VARCHAR AS id, 1 + id % 2 AS d, seq FROM r")
def fastq_round_trip(spark, sf_dir):
    return fasta.read_fastq(spark, _fastq(spark, sf_dir, compression="gzip")).select("id", F.col("d").cast("long").alias("d"), "seq")


@query(f"{_READS} SELECT id::VARCHAR AS id, upper(seq) AS seq, true AS from_file FROM r")
def fastq_with_file(spark, sf_dir):
    """Each read with the hash of its file's name, which must be that of one of the files."""
    path = _fastq(spark, sf_dir)
    r = fasta.read_fastq(spark, path, fold=False, with_file=True)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    known = files.select(sequences.string_hash(F.col("name")).alias("file_hash"), F.lit(True).alias("known")).distinct()
    return r.join(known, "file_hash", "left").select("id", "seq", F.coalesce("known", F.lit(False)).alias("from_file"))


@query(f"{_READS} SELECT count(*) AS n_reads, sum(length(seq))::BIGINT AS n_bases FROM r")
def fasta_blocks(spark, sf_dir):
    path = _scratch(spark, "blocks")
    fasta.write_fasta(reads(spark, sf_dir), path)
    b = fasta.read_fasta_blocks(spark, path).select(F.explode("reads").alias("r"))
    return b.agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("r.seq")).alias("n_bases"))


@query(f"{_READS} SELECT id::VARCHAR AS id, 1 + id % 2 AS d, seq FROM r")
def fastq_blocks(spark, sf_dir):
    b = fasta.read_fastq_blocks(spark, _fastq(spark, sf_dir)).select(F.explode("reads").alias("r"))
    return b.select("r.id", F.col("r.d").cast("long").alias("d"), "r.seq")


@query(f"{_READS} SELECT id::VARCHAR || '/1' AS name, seq, (SELECT count(*) FROM r) AS n FROM r")
def sequence_files(spark, sf_dir):
    """Whole names and sequences of files with lengths in their headers, and how many there are."""
    path = _scratch(spark, "sequences")
    r = reads(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit("/1")).alias("id"), "seq")
    fasta.write_fasta(r, path, with_length=True)
    return fasta.read_sequences(spark, path).withColumn("n", F.lit(fasta.count_sequences(spark, path)).cast("long"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_round_trip(spark, sf_dir):
    path = _scratch(spark, "table")
    fasta.write_text(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, delimiter="|")
    return fasta.read_table(spark, path, "n_nationkey int, n_name string, n_regionkey int", delimiter="|")


@query(f"{_READS}, {_windows('r', 6, 'k')} SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer")
def stream_kmer_count(spark, sf_dir):
    """K-mers of files that arrive in a folder, counted by a stream over all that are there."""
    work = Workspace(spark, "stream")
    path, out = work.path("in"), work.path("out")
    fasta.write_fasta(reads(spark, sf_dir), path)
    counts = kmer_stream.kmer_counts(kmer_stream.stream_fasta(spark, path), "seq", 6)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", work.path("state")).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT '(' || n_nationkey || ',' || n_name || ')' || chr(9) || '{' || n_regionkey || ',' || n_nationkey || '}' AS value FROM nation")
def nested_text(spark, sf_dir):
    path = _scratch(spark, "text")
    n = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name").alias("t"), F.array("n_regionkey", "n_nationkey").alias("b"))
    fasta.write_text(n, path)
    return spark.read.text(path)


# --- relational operators ---------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def rel_join(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = line.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rel_replicated_join(spark, sf_dir):
    n = matching.bounded(table(spark, sf_dir, "nation"))
    j = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT key, (SELECT count(*) FROM customer WHERE c_nationkey = key) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = key) AS n_suppliers FROM (SELECT DISTINCT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def rel_cogroup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "key")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key")
    g = relational.cogroup(c.select("key", "c_custkey"), s.select("key", "s_suppkey"), "key")
    return g.select("key", F.size("left_bag").cast("long").alias("n_customers"), F.size("right_bag").cast("long").alias("n_suppliers"))


@query("SELECT a.r_name AS r_name1, b.r_name AS r_name2 FROM region a CROSS JOIN region b")
def rel_cross(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_name")
    return relational.cross(r, r)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def rel_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top(spark, sf_dir):
    return relational.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


@query("SELECT l_orderkey, count(l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(l_partkey) = 2")
def rel_having(spark, sf_dir):
    return relational.having(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "n = 2", n=F.count("l_partkey"))


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS rank FROM customer")
def rel_rank(spark, sf_dir):
    return relational.rank(table(spark, sf_dir, "customer"), [F.col("c_acctbal").desc()], within=["c_mktsegment"]).select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf_dir):
    return relational.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), qty=F.sum("l_quantity"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rel_rollup(spark, sf_dir):
    return relational.rollup(table(spark, sf_dir, "part"), ["p_brand", "p_type"], n=F.count(F.lit(1)))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def rel_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def rel_outer_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS part, count(*) AS n FROM orders GROUP BY 1")
def rel_split(spark, sf_dir):
    s = relational.split(table(spark, sf_dir, "orders"), done="o_orderstatus = 'F'", open="o_orderstatus <> 'F'")
    return s["done"].agg(F.lit("done").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(s["open"].agg(F.lit("open").alias("part"), F.count(F.lit(1)).alias("n")))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, '.*[aeiou].*[aeiou].*[aeiou].*')")
def rel_matches(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~relational.matches("p_name", ".*[aeiou].*[aeiou].*[aeiou].*")).select("p_partkey", "p_name")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\",()*]+')) AS token FROM benchmark) WHERE token <> '' GROUP BY token")
def rel_tokenize(spark, sf_dir):
    t = relational.tokenize(table(spark, sf_dir, "benchmark").select("text"), "text")
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def rel_flatten(spark, sf_dir):
    g = relational.group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"])
    return relational.flatten_tuple(relational.flatten_bag(g.select("bag"), "bag", "t"), "t")


@query("SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey")
def rel_right_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    m = c.select("key", F.col("key").alias("c_custkey"))
    return relational.join(m, o.select("key", "o_orderkey"), ["key"], "right").select("c_custkey", "o_orderkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS key, coalesce(nc, 0) AS nc, coalesce(ns, 0) AS ns FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_nationkey < 20 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_nationkey > 4 GROUP BY 1) ON c_nationkey = s_nationkey")
def rel_full_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("nc"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("ns"))
    return relational.join(c, s, ["key"], "full").fillna(0, ["nc", "ns"])


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def rel_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.join(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], "anti")


@query("SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def rel_skewed_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return relational.skewed_join(line, o, "key").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, p_name FROM orders JOIN part ON o_custkey = p_partkey")
def rel_merge_join(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return relational.merge_join(o, p, "key", parallel=4).select("o_orderkey", "p_name")


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark, sf_dir):
    return relational.intersect(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))


@query("SELECT c_nationkey AS key FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def rel_except(spark, sf_dir):
    return relational.difference(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), all=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(sha256('5:' || o_orderkey::VARCHAR), 1, 8))::BIGINT < 0.3 * 4294967296")
def rel_sample(spark, sf_dir):
    return relational.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 0.3, seed=5, by="o_orderkey")


@query("SELECT p_partkey, upper(p_name) AS p_name FROM part")
def rel_stream_through(spark, sf_dir):
    return external.stream_through(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "tr a-z A-Z", "p_partkey bigint, p_name string")


@query("SELECT key, a, b FROM (SELECT o_custkey AS key, unnest(list(o_orderkey ORDER BY o_orderkey)) AS a, list(o_orderstatus) AS bs FROM orders GROUP BY 1), unnest(bs) u(b)")
def rel_two_flattens(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderkey").alias("a"), F.collect_list("o_orderstatus").alias("b"))
    return relational.flatten_bags(g, "a", "b")


@query("SELECT o_custkey AS key, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def rel_bag_projection(spark, sf_dir):
    g = relational.group(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus"), ["key"])
    p = relational.project_bag(g, "bag", "o_orderkey", "keys")
    return p.select("key", F.array_join(F.transform(F.array_sort("keys"), lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, min(l_shipdate)::VARCHAR AS first, max(l_extendedprice) AS most, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def rel_aggregates(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.max("l_extendedprice").alias("most"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query(f"WITH m AS (SELECT conv_id AS id, turn, {_SEQ} AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT id, 0 AS d, min_by(seq, turn) || reverse(max_by(seq, turn)) AS seq FROM m WHERE n = 2 GROUP BY id")
def pair_merge_strict(spark, sf_dir):
    m = _mates(spark, sf_dir)
    two = m.groupBy("conv_id").count().where("count = 2").select("conv_id")
    return groups.pair_merge(m.join(two, "conv_id", "left_semi"), "conv_id", "turn", "seq", strict=True)


@query(f"{_READS} SELECT id, reverse(translate(seq, 'atgc', 'tacg')) AS rc, CASE WHEN length(seq) >= 45 THEN substr(seq, 11, 35) END AS part, CASE WHEN length(seq) >= 8 THEN substr(seq, 1, 8) || substr(reverse(seq), 1, 8) END AS hash, seq AS unpacked, least(substr(seq, 1, 6), reverse(translate(substr(seq, 1, 6), 'atgc', 'tacg'))) AS first FROM r WHERE length(seq) >= 6 AND NOT contains(substr(seq, 1, 6), 'n')")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    r = reads(spark, sf_dir)
    return spark.sql(
        """SELECT id, reverse_complement(seq) AS rc, subsequence(seq, 10, 45) AS part, identity_hash(seq, 8) AS hash, unpack_bases(pack_bases(seq)) AS unpacked,
        canonical_kmer(kmers(substring(seq, 1, 6), 6)[0]) AS first FROM {r} WHERE num_bases(seq) >= 6 AND size(kmers(substring(seq, 1, 6), 6)) > 0""",
        r=r,
    )


@query(f"{_READS}, {_windows('r', 12, 'k')} SELECT cnt, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer) GROUP BY cnt")
def recipe_parameters(spark, sf_dir):
    """A recipe whose k comes from the session's settings."""
    spark.conf.set("strandlake.kmer_stats.k", "12")
    try:
        args = recipes.parameters(spark, recipes.kmer_stats, reads=reads(spark, sf_dir), seq="seq")
    finally:
        spark.conf.unset("strandlake.kmer_stats.k")
    return recipes.kmer_stats(**args)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def rel_parallel(spark, sf_dir):
    o = relational.parallel(table(spark, sf_dir, "orders").select("o_custkey"), 6, "o_custkey")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

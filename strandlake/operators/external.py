"""Alignment and assembly programs, run per partition or per group.

A :class:`Tool` holds a command line in which ``{input}``, ``{db}`` and ``{dir}`` stand
for files of a temporary folder that is removed afterwards. Programs are injected, so
any executable that keeps the contract can take the place of the usual ones.
"""

from __future__ import annotations

import os
import re
import shlex
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from hashlib import sha256
from itertools import chain, groupby, islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.plans.session import ship_package


class ToolError(RuntimeError):
    """A program has failed or run out of time."""


@dataclass
class Tool:
    """``command``: a template; ``output``: the file with the result, standard output if None.

    ``setup``: commands that run first; ``missing_ok``: no output file means no contigs.
    """

    command: str
    output: str | None = None
    setup: list[str] = field(default_factory=list)
    timeout: float = 3600.0
    missing_ok: bool = False

    def run(self, files: dict[str, str | Iterator[str]], **values: object) -> str:
        """Write ``files``, run the commands and return the result; ``values`` fill the template too."""
        with self.result(files, **values) as path:
            return path.read_text() if path else ""

    @contextmanager
    def result(self, files: dict[str, str | Iterator[str]], **values: object) -> Iterator[Path | None]:
        """As :meth:`run`, but the file with the result, so that it need not be held in memory; None if it may be missing and is."""
        with tempfile.TemporaryDirectory(dir=os.path.realpath(tempfile.gettempdir())) as tmp:  # the programs run elsewhere
            names = {"dir": tmp, **{k: str(v) for k, v in values.items()}}
            for name, text in files.items():
                path = Path(tmp, f"{name}.fa")
                with path.open("w") as f:
                    f.writelines([text] if isinstance(text, str) else text)
                names[name] = str(path)
            said = Path(tmp, "_said")
            for c in [*self.setup, self.command]:
                words = [w.format(**names) for w in shlex.split(c)]
                try:
                    with said.open("w") as o:
                        done = subprocess.run(words, cwd=tmp, stdout=o, stderr=subprocess.PIPE, text=True, timeout=self.timeout)
                except (OSError, subprocess.TimeoutExpired) as e:
                    raise ToolError(f"{words[0]}: {e}") from e
                if done.returncode:
                    raise ToolError(f"{words[0]} ended with {done.returncode}: {done.stderr[-500:]}")
            path = said if self.output is None else Path(tmp, self.output.format(**names))
            if not path.exists():
                if not self.missing_ok:
                    raise ToolError(f"{self.output} is missing")
                path = None
            yield path


#: The usual programs; flags can be changed by building another Tool.
TOOLS = {
    "blast": Tool("blastall -m 8 -p blastn -b 1000000 -a 1 -z {effective} -e {evalue} -i {query} -d {reads} -o {dir}/out", "{dir}/out", ["formatdb -o T -p F -i {reads}"]),
    "blat": Tool("blat {reads} {query} -out=blast8 {dir}/out", "{dir}/out"),
    "cap3": Tool("cap3 {reads}", "{reads}.cap.contigs"),
    "velvet": Tool("velvetg {dir}/v", "{dir}/v/contigs.fa", ["velveth {dir}/v 31 -short {reads}"], missing_ok=True),
    "minimus": Tool("minimus {dir}/m", "{dir}/m.fasta", ["toAmos -s {reads} -o {dir}/m.afg"], missing_ok=True),
    "newbler": Tool("runAssembly -o {dir}/n {reads}", "{dir}/n/454AllContigs.fna", missing_ok=True),
}


def configured(spark: SparkSession, name: str) -> Tool:
    """The usual program of that name with what the session sets below ``strandlake.<name>.``.

    Settings: command, output, setup (commands parted by ``;``), timeout, missing_ok. The
    session's own settings stand above those of its submission and of its defaults file.
    """
    base = TOOLS[name]
    get = lambda k: spark.conf.get(f"strandlake.{name}.{k}", None)
    changes: dict = {k: v for k in ("command", "output") if (v := get(k)) is not None}
    if (v := get("setup")) is not None:
        changes["setup"] = [c.strip() for c in v.split(";") if c.strip()]
    if (v := get("timeout")) is not None:
        changes["timeout"] = float(v)
    if (v := get("missing_ok")) is not None:
        changes["missing_ok"] = v.lower() == "true"
    return replace(base, **changes)


def stream_through(df: DataFrame, command: str, schema: str, delimiter: str = "\t", timeout: float = 3600.0) -> DataFrame:
    """Rows of each partition, as delimited text, through a program; its lines are the new rows.

    Nulls go in as empty fields; fields come back as strings and are cast to ``schema``. The
    program reads and writes files of its own, so a partition is never held in memory.
    """
    ship_package(df.sparkSession)
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(F.concat_ws(delimiter, *cols).alias("line"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory(dir=os.path.realpath(tempfile.gettempdir())) as tmp:  # the programs run elsewhere
            given, made = Path(tmp, "in"), Path(tmp, "out")
            with given.open("w") as f:
                f.writelines(f"{x}\n" for pdf in frames for x in pdf["line"])
            with given.open() as i, made.open("w") as o:
                try:
                    done = subprocess.run(shlex.split(command), stdin=i, stdout=o, stderr=subprocess.PIPE, cwd=tmp, timeout=timeout)
                except (OSError, subprocess.TimeoutExpired) as e:
                    raise ToolError(f"{command}: {e}") from e
            if done.returncode:
                raise ToolError(f"{command} ended with {done.returncode}: {done.stderr[-500:]!r}")
            with made.open() as o:
                while some := list(islice(o, 10_000)):
                    yield pd.DataFrame({"line": [x.rstrip("\n") for x in some]})

    parts = F.split("line", re.escape(delimiter))
    fields = T.StructType.fromDDL(schema).fields
    return lines.mapInPandas(run, "line string").select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def scaled_evalue(evalue: float, partition_bases: int, total_bases: int) -> float:
    """An e-value for one partition that equals ``evalue`` for the whole database."""
    return evalue * partition_bases / max(1, total_bases)


def to_fasta(rows: Iterator[tuple[str, str]]) -> str:
    return "".join(f">{i}\n{s}\n" for i, s in rows)


def from_fasta(text: str) -> list[tuple[str, str]]:
    out = []
    for chunk in ("\n" + text.replace("\r\n", "\n")).split("\n>")[1:]:
        head, _, body = chunk.partition("\n")
        out.append((head.split()[0] if head.split() else "", "".join(body.split())))
    return out


def _named(pdf: pd.DataFrame) -> list[tuple[str, str]]:
    return [(f"{i}/{d}" if d is not None and str(d) not in ("", "0", "nan") else str(i), s) for i, d, s in zip(pdf["id"], pdf["d"], pdf["seq"], strict=True)]


def blast(reads: DataFrame, query: str, tool: Tool = TOOLS["blast"], evalue: float = 10.0, total_bases: int | None = None) -> DataFrame:
    """geneid, id, d, seq: hits of each partition's reads against the sequences of ``query`` (FASTA text).

    The program runs once for a partition. Column 0 of its rows is the gene, column 1 the
    read as id/d; all reads of that name are hits. ``evalue`` holds for the whole database:
    its part for the partition's bases fills ``{evalue}``, and ``total_bases`` (counted if
    not given) ``{effective}``.
    """
    ship_package(reads.sparkSession)
    r = reads.select(F.col("id").cast("string"), F.col("d").cast("int"), F.col("seq").cast("string"))
    if total_bases is None:
        total_bases = r.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[tuple]] = {}
        for pdf in frames:
            for (name, _), row in zip(_named(pdf), pdf.itertuples(index=False), strict=True):
                by.setdefault(name, []).append(tuple(row))
        if not by:
            return
        bases = sum(len(x[2] or "") for rows in by.values() for x in rows)
        text = (f">{n}\n{x[2] or ''}\n" for n, rows in by.items() for x in rows)
        found = tool.run({"reads": text, "query": query}, effective=total_bases, evalue=scaled_evalue(evalue, bases, total_bases))
        hits = [line.split("\t") for line in found.splitlines() if line]
        pairs = dict.fromkeys((h[0], h[1]) for h in hits if len(h) > 1 and h[1] in by)
        yield pd.DataFrame([(g, *x) for g, r in pairs for x in by[r]], columns=["geneid", "id", "d", "seq"])

    return r.mapInPandas(run, "geneid string, id string, d int, seq string")


def grouped_hits(hits: DataFrame) -> DataFrame:
    """geneid, reads: one row per gene with an array of (id, d, seq)."""
    return hits.groupBy("geneid").agg(F.array_sort(F.collect_list(F.struct("id", "d", "seq"))).alias("reads"))


def _contigs(path: Path | None) -> Iterator[tuple[str, str, int]]:
    """(name, sequence, place in the file) of a FASTA file, one at a time, as :func:`from_fasta` has them."""
    if path is None:
        return
    name, body, at, begin = None, [], 0, 0
    with path.open("rb") as f:
        for line in f:
            if line.startswith(b">"):
                if name is not None:
                    yield name, "".join(body), begin
                name, body, begin = (line[1:].decode().split() or [""])[0], [], at
            elif name is not None:
                body += line.decode().split()
            at += len(line)
    if name is not None:
        yield name, "".join(body), begin


def _longest(path: Path | None) -> list[tuple[str, str]]:
    """The longest contig, the first of equal ones, if there is any."""
    best = max(_contigs(path), key=lambda x: len(x[1]), default=None)
    return [best[:2]] if best else []


def _fasta_lines(rows: Iterator[tuple]) -> Iterator[str]:
    return (f">{i}/{d}\n{s}\n" if d is not None and str(d) not in ("", "0", "nan") else f">{i}\n{s}\n" for i, d, s in rows)


def _grouped(df: DataFrame, key: str, work: Callable[[str, Iterator[tuple]], Iterator[tuple]], schema: str, own: bool = False) -> DataFrame:
    """Rows that ``work`` makes of a group's name and its (id, d, seq), which it takes as they come.

    Groups are sorted by Spark, which spills, so that a group is never held in memory.
    ``own``: the reads come by id, d and sequence, those whose id is the group first.
    """
    ship_package(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    d = df.select(F.col(key).alias("key"), *[F.col(c) for c in ("id", "d", "seq")])
    order: list[Column] = [F.col("key")]
    if own:
        order += [(~F.col("id").cast("string").eqNullSafe(F.col("key").cast("string"))), *[F.col(c).asc_nulls_last() for c in ("id", "d", "seq")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    yield tuple(c[i].as_py() for c in b.columns)

        made, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*made, strict=True)], names=names)

        for k, group in groupby(rows(), lambda r: r[0] if r[0] == r[0] else "nan"):
            for r in work(str(k), (x[1:] for x in group)):
                made.append(r)
                size += sum(map(len, r))
                if size >= 1 << 22:
                    yield batch()
                    made, size = [], 0
        if made:
            yield batch()

    return d.repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)


def assemble_longest(reads: DataFrame, key: str, tool: Tool) -> DataFrame:
    """group, contig, seq: the longest contig of each group's assembly; a group without contigs has no row."""

    def work(g: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        with tool.result({"reads": _fasta_lines(rows)}) as path:
            for c in _longest(path):
                yield g, *c

    return _grouped(reads, key, work, "group string, contig string, seq string")


def assemble_improved(reads: DataFrame, key: str, tool: Tool = TOOLS["newbler"]) -> DataFrame:
    """Contigs longer than the longest read; without any, the longest contig."""

    def work(g: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        longest = 0

        def seen() -> Iterator[tuple]:
            nonlocal longest
            for r in rows:
                longest = max(longest, len(r[2] or ""))
                yield r

        with tool.result({"reads": _fasta_lines(seen())}) as path:
            better = False
            for name, s, _ in _contigs(path):
                if len(s) > longest:
                    better = True
                    yield g, name, s
            if not better:
                for c in _longest(path):
                    yield g, *c

    return _grouped(reads, key, work, "group string, contig string, seq string")


def assemble_by_key(reads: DataFrame, key: str, tool: str | Tool = "velvet", keep_top: bool = False, drop_identical: bool = False, limit: int | None = None, seeds: dict[str, str] | None = None) -> DataFrame:
    """group, contig, seq, header by length from the longest, ties by name.

    Reads of a group come in the order of id, d and sequence. The read whose id is the
    group is its seed; ``seeds`` may give others by group. ``drop_identical``: equal reads
    once; ``limit``: only the first so many reads are assembled, the seed beside them.
    With a seed only longer contigs are returned. ``header`` is ``>group-contig
    numberOfReadsInput=n``, with the limit where it has left reads out. Of a group's reads
    and contigs only hashes (with ``drop_identical``) and places in a file are held.
    """
    t = configured(reads.sparkSession, tool) if isinstance(tool, str) else tool

    def work(g: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        n, seed = 0, (seeds or {}).get(g)

        def chosen() -> Iterator[tuple]:
            nonlocal n, seed
            given, own, known = 0, False, set()
            for r in rows:
                n += 1
                if str(r[0]) == g:
                    if own:
                        continue
                    own = True
                    seed = (seeds or {}).get(g, r[2])
                elif limit is not None and given >= limit:
                    continue
                if drop_identical:
                    h = None if r[2] is None else sha256(r[2].encode("utf-8", "surrogatepass")).digest()
                    if h in known:
                        continue
                    known.add(h)
                given += 1
                yield r

        taken = chosen()
        head = next(taken, None)
        if head is None:
            return
        with t.result({"reads": _fasta_lines(chain([head], taken))}) as path:
            short = -1 if seed is None else len(seed)
            found = ((-len(s), name, at) for name, s, at in _contigs(path) if len(s) > short)
            places = [x] if keep_top and (x := min(found, default=None)) else sorted(found)
            left = f"limit={limit}" if limit is not None and limit < n else ""
            for _, name, at in places:
                yield g, name, _contig_at(path, at), f">{g}-{name} numberOfReadsInput={n} {left}"

    return _grouped(reads, key, work, "group string, contig string, seq string, header string", own=True)


def _contig_at(path: Path, at: int) -> str:
    with path.open("rb") as f:
        f.seek(at)
        f.readline()
        body = []
        for line in f:
            if line.startswith(b">"):
                break
            body += line.decode().split()
        return "".join(body)


def extend_contig(contigs: DataFrame, reads: DataFrame, key: str, tool: Tool = TOOLS["cap3"]) -> DataFrame:
    """group, seq, extended: each contig assembled with its reads; extended is 1 if the result is longer.

    A contig without reads comes back with 0. Parentheses around a contig are removed.
    """
    ship_package(contigs.sparkSession)
    c = contigs.select(F.col(key).cast("string").alias("group"), F.regexp_replace("seq", "^\\((.*)\\)$", "$1").alias("contig"))
    r = reads.select(F.col(key).cast("string").alias("group"), F.col("id").cast("string"), F.col("d").cast("int"), F.col("seq").cast("string"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, contig in a[["group", "contig"]].itertuples(index=False):
            best = contig
            if len(b):
                for _, s in from_fasta(tool.run({"reads": to_fasta([("contig", contig), *_named(b)])})):
                    best = s if len(s) > len(best) else best
            out.append((g, best, int(len(best) > len(contig))))
        return pd.DataFrame(out, columns=["group", "seq", "extended"])

    return c.groupBy("group").cogroup(r.groupBy("group")).applyInPandas(work, "group string, seq string, extended int")


def blat_groups(groups: DataFrame, database: DataFrame, tool: Tool = TOOLS["blat"], bases: int = 64 << 20) -> DataFrame:
    """group, reads: for each group of reads, the database's reads that they hit, with their mates.

    ``groups``: group, id, d, seq; ``database``: id, d, seq. A group's reads and their mates,
    as the database has them, are the query. The program's rows name the database's read in
    column 1. The database is searched in parts of about ``bases`` bases, and as many bases
    of queries go to a task together; hits of all parts are united.
    """
    ship_package(groups.sparkSession)
    db = database.select(F.col("id").cast("string"), F.col("d").cast("int"), F.col("seq").cast("string"))
    named = groups.select(F.col("group").cast("string"), F.col("id").cast("string")).distinct().join(db, "id").select(*[F.col(c).alias(c) for c in ("group", "id", "d", "seq")])
    count = lambda df: max(1, -(-(df.agg(F.sum(F.length("seq"))).first()[0] or 0) // bases))
    parts, many = count(db), count(named)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = db.withColumn("part", F.pmod(F.xxhash64("id", "d", "seq"), F.lit(parts)).cast("int")).withColumn("lot", each(many))
    right = named.withColumn("lot", F.pmod(F.xxhash64("group"), F.lit(many)).cast("int")).withColumn("part", each(parts))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, reads = [], to_fasta(_named(a))
        for g, own in b.groupby("group", sort=False, dropna=False):
            hit = tool.run({"reads": reads, "query": to_fasta(_named(own))}) if reads else ""
            out.append((g, sorted({line.split("\t")[1] for line in hit.splitlines() if line.count("\t")})))
        return pd.DataFrame(out, columns=["group", "hit"])

    hits = left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot")).applyInPandas(work, "group string, hit array<string>")
    return hits.groupBy("group").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))), ", ").alias("reads"))

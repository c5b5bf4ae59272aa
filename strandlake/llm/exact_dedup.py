"""Exact dedup: Patricia-trie owners.

Two tries run per text. Each input partition inserts its normalised texts into a
compressed radix trie and emits one row per distinct text (smallest id, count), so a
group that holds a third of all rows leaves each task as one row. These rows are dealt
by length and content hash, and each partition inserts its full byte strings, in order,
into a second trie whose terminals store the smallest id and the total of each text.
Whenever the second trie outgrows its budget the subtrees that the order has passed are
spilled: no later text can reach them, so their terminals are final. The first trie
spills its largest subtree instead; partial groups meet again in the second. Memory is
bounded by the budget and the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.textnum import trimmed
from strandlake.plans.session import Workspace, dealt_join, hot_keys, ship_package

#: Fixed value: the white space that normalisation collapses, as bytes.
BLANKS = b"\t\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(BLANKS, b" " * len(BLANKS))
#: The same as a Java pattern; single spaces stay as they are.
RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalise(text: str | None) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty. UTF-8."""
    b = (text or "").encode("utf-8", "replace").translate(_TO_SPACE)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return b


class Node:
    __slots__ = ("label", "kids", "terminal")

    def __init__(self, label: bytes, terminal: list | None = None):
        self.label, self.kids, self.terminal = label, {}, terminal


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving so that the work is done in C compares."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal holds [smallest id, count].

    A null id is larger than any other. ``size`` estimates the bytes held.
    """

    NODE_BYTES = 200

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, pos = self.root, 0
        while True:
            if pos == len(key):
                return self._own(node, owner, count)
            kid = node.kids.get(key[pos])
            if kid is None:
                node.kids[key[pos]] = Node(key[pos:], [owner, count])
                self.size += len(key) - pos + self.NODE_BYTES
                return None
            rest = key[pos:]
            n = _common(kid.label, rest)
            if n < len(kid.label):
                upper = Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[pos]] = upper
                self.size += self.NODE_BYTES
                kid = upper
            node, pos = kid, pos + n

    def _own(self, node: Node, owner: int | None, count: int) -> None:
        t = node.terminal
        if t is None:
            node.terminal = [owner, count]
            return
        if owner is not None and (t[0] is None or owner < t[0]):
            t[0] = owner
        t[1] += count

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            here = prefix + node.label
            if node.terminal is not None:
                yield here, *node.terminal
            stack += [(k, here) for k in node.kids.values()]

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """All terminals; the trie is empty afterwards."""
        root, self.root, self.size = self.root, Node(b""), 0
        yield from self._walk(root, b"")

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals of the largest subtree below the root, which is then freed."""
        if not self.root.kids:
            yield from self.drain()
            return
        sizes = {k: self._bytes(n) for k, n in self.root.kids.items()}
        k = max(sizes, key=sizes.get)
        node = self.root.kids.pop(k)
        self.size -= sizes[k]
        yield from self._walk(node, b"")

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals of the subtrees that lie before ``key``, off its path; they are freed.

        Texts that come in order after ``key`` can reach none of them.
        """
        node, pos = self.root, 0
        while pos < len(key):
            here = key[:pos]
            for b in sorted(k for k in node.kids if k < key[pos]):
                kid = node.kids.pop(b)
                self.size -= self._bytes(kid)
                yield from self._walk(kid, here)
            kid = node.kids.get(key[pos])
            if kid is None or not key.startswith(kid.label, pos):
                return
            node, pos = kid, pos + len(kid.label)

    def _bytes(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + self.NODE_BYTES
            stack += n.kids.values()
        return total


_PARTIAL = "len long, hash long, text binary, owner long, n long"
_OWNERS = "len long, text_sha256 string, keep_id long, group_size long"


def _hash64(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def _partials(rows: list[tuple[bytes, int | None, int]]) -> pa.RecordBatch:
    texts = [r[0] for r in rows]
    return pa.record_batch(
        [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([_hash64(t) for t in texts], pa.int64()),
            pa.array(texts, pa.binary()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        names=["len", "hash", "text", "owner", "n"],
    )


def _batches(rows: Iterator, budget: int = 4 << 20) -> Iterator[list]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[0])
        if held >= budget or len(out) >= 4096:
            yield out
            out, held = [], 0
    if out:
        yield out


def _local(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                trie.insert(normalise(t.as_py()), i.as_py())
                while trie.size > trie_bytes:
                    yield from map(_partials, _batches(trie.spill()))
        yield from map(_partials, _batches(trie.drain()))

    return run


def _owners(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = PatriciaTrie(), []

        def put(found: Iterator) -> None:
            for text, owner, n in found:
                out.append((len(text), hashlib.sha256(text).hexdigest(), owner, n))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["len", "text_sha256", "keep_id", "group_size"])

        limit = trie_bytes
        for b in batches:
            for text, owner, n in zip(*b.columns, strict=True):
                text = text.as_py()
                trie.insert(text, owner.as_py(), n.as_py())
                if trie.size > limit:
                    put(trie.spill_before(text))
                    limit = max(trie_bytes, 2 * trie.size)  # one path is left; a very long text may be above the budget alone
                    if len(out) > 4096:
                        yield flush()
        put(trie.drain())
        if out:
            yield flush()

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 24 << 20) -> DataFrame:
    """One row per distinct normalised text: len, text_sha256, keep_id, group_size."""
    ship_package(docs.sparkSession)
    part = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(_local(trie_bytes)), _PARTIAL)
    dealt = part.repartition("len", "hash").sortWithinPartitions("text").select("text", "owner", "n")
    return dealt.mapInArrow(trimmed(_owners(trie_bytes)), _OWNERS)


def text_key(text_col: str) -> Column:
    """Column: the normalised text, as :func:`normalise` makes it."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), RUNS, " ")


def first_rows(docs: DataFrame, kept: DataFrame, key: Column, sha: Column) -> DataFrame:
    """The rows of ``docs`` whose (``key``, ``sha``) is in ``kept`` (id, sha), one for each; all their columns.

    Rows travel as one struct, so no name can clash, and are shuffled once.
    """
    cols = docs.columns
    by = lambda k, s: (F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("none"), s.alias("s"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *by(key, sha))
    rows = rows.join(kept.select(*by(F.col("id"), F.col("sha"))), ["k", "none", "s"], "left_semi")
    w = Window.partitionBy("k", "none", "s").orderBy(F.lit(1))
    rows = rows.withColumn("at", F.row_number().over(w)).where("at = 1")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in cols])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 24 << 20) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of rows with equal texts the smallest id stays; a null id
    is the largest and stays only where its group has no other. Of rows that repeat both
    id and text exactly one is kept. Very long texts are inserted whole. Other columns of
    ``docs`` are not read, so their names cannot clash. An empty table gives an empty
    result. Two texts count as equal in the join back if length and sha256 agree.
    """
    work = Workspace(docs.sparkSession, "exact")
    own = work.written(owners(docs, id_col, text_col, trie_bytes), "owners")
    norm = text_key(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), norm.alias("t")).select("id", F.sha2("t", 256).alias("text_sha256"))
    rows = rows.groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    j = dealt_join(rows, own.drop("len"), "text_sha256", hot_keys(own, "text_sha256", "group_size", total), "id")
    j = j.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return j.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    As in :func:`exact_dedup`: null texts are empty, a null id stays only where its group
    has no other, and where rows repeat both id and text one of them stays. An empty table
    gives an empty result.
    """
    work = Workspace(docs.sparkSession, "exact")
    kept = work.written(owners(docs, id_col, text_col).select(F.col("keep_id").alias("id"), F.col("text_sha256").alias("sha")), "owners")
    return first_rows(docs, kept, F.col(f"`{id_col}`").cast("long"), F.sha2(text_key(text_col), 256))

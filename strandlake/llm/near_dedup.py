"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles: mergeable lossy counts of each task name
   candidates, which are then counted exactly over all documents. Only shingles in more
   than a fixed share of the documents count, so there are at most (shingles per
   document) / share of them whatever the input, and they can be broadcast.
2. Each document's weighted shingles are sampled consistently; samples form bands, and
   documents that share a band are candidates. Copies of one shingle set are one node.
3. In each bucket every node is first compared with the bucket's least node. Buckets that
   then still hold more than one component are compared by samples, in blocks of bounded
   size that a task holds as one matrix. Nodes with a promising partner in another
   component get their vectors and are verified in blocks bounded in bytes; only links
   that join components leave a task. No group emits all its pairs, and no link between
   components is left out.
4. Every link is verified by the weighted Jaccard similarity of whole texts. Components
   are found by hooking and pointer jumping on tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.exact_dedup import first_rows
from strandlake.llm.textnum import Texts, mix, shingles, slices, trimmed
from strandlake.plans.session import Workspace, dealt_join, hot_keys, ship_package

WORDS, SIMILAR = 5, 0.8
#: Shingles in more than this share of the documents are counted.
COMMON = 1 / 1024
#: How much more the rarest shingles weigh than one that every document has.
DAMP = 1 / 3
BANDS, ROWS = 14, 4
KEY_BITS = 44
TABLE_BITS = 14


def keyed(texts: list[str | None], n: int = WORDS) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, text of each distinct shingle, its key, how often it occurs), by text, then key.

    Words are runs of anything but ASCII white space, with ASCII letters in lower case.
    """
    t = Texts(texts)
    t.words()
    key, doc = shingles(t.word_hashes(fold=True), t.words_from, n)
    both = (doc.astype(np.uint64) << np.uint64(KEY_BITS)) | (key >> np.uint64(64 - KEY_BITS))
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(both)))
    both = both[first]
    return t, (both >> np.uint64(KEY_BITS)).astype(np.int64), both & np.uint64((1 << KEY_BITS) - 1), tf


# --- document frequencies ---------------------------------------------------------


def _five(a: np.ndarray) -> bytes:
    """The lower 40 bits of each key."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(b: bytes) -> np.ndarray:
    a = np.zeros((len(b) // 5, 8), np.uint8)
    a[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return a.view("<u8").reshape(-1)


def _ranged(keys: np.ndarray, count: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, counts) of sorted keys, a row for each key range."""
    edge = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
    rows = []
    for b in np.flatnonzero(np.diff(edge)).tolist():
        rows.append((b, _five(keys[edge[b] : edge[b + 1]]), count[edge[b] : edge[b + 1]].astype("<u4").tobytes()))
    for i in range(0, len(rows), 64):
        cols = list(zip(*rows[i : i + 64], strict=True))
        yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "counts"])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _summaries(bits: int, n: int, rate: float, hold: int = 1 << 20):
    """Lossy counts of a task's shingles: of each stretch of documents, keys in more than ``rate`` / 2 of them.

    A key loses that share of a stretch at most, so half of ``rate`` over all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(first, len(keys)))
            some = count > rate * docs / 2
            yield from _ranged(keys[first][some], count[some], bits)

        for b in slices(batches, 0):
            _, _, key, _ = keyed(b.column(0).to_pylist(), n)
            held.append(key)
            size += len(key)
            docs += b.num_rows
            if size >= hold:
                yield from flush()
                size = docs = 0
        if size:
            yield from flush()

    return run


def _exact(bits: int, n: int, wanted: np.ndarray):
    """How many of a task's documents have each wanted key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in slices(batches, 0):
            _, _, key, _ = keyed(b.column(0).to_pylist(), n)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            total += np.bincount(at[wanted[at] == key], minlength=len(wanted))
        some = total > 0
        yield from _ranged(wanted[some], total[some], bits)

    return run


def _frequent(bits: int, least: float):
    """Keys whose counts add up to ``least`` or more; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            k, total = _merged(keys, counts)
            big = total >= least
            low = k[big] & np.uint64((1 << (KEY_BITS - bits)) - 1)
            if big.any():
                yield pa.record_batch([pa.array((low | (np.uint64(at) << np.uint64(KEY_BITS - bits))).astype(np.int64)), pa.array(total[big].astype(np.int64))], names=["key", "df"])

        for b in batches:
            for bucket, k, c in zip(*b.columns, strict=True):
                bucket = bucket.as_py()
                if bucket != at and keys:
                    yield from close()
                    keys, counts = [], []
                at = bucket
                keys.append(_from_five(k.as_py()))
                counts.append(np.frombuffer(c.as_py(), "<u4").astype(np.int64))
        if keys:
            yield from close()

    return run


def frequent_shingles(docs: DataFrame, least: float, text_col: str = "text", n: int = WORDS, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, document frequencies) of the shingles in ``least`` documents or more, sorted by key.

    Mergeable lossy counts give candidates, none of which can be missed: each task leaves
    out what is rare among its documents, in all half of ``least`` at most. The candidates
    are then counted exactly over all documents. With ``least`` a share of ``total`` there
    are 2 * (shingles per document) / share candidates at most, whatever the input.
    """
    total = docs.count() if total is None else total
    parts = docs.rdd.getNumPartitions()
    bits = min(24, max(4, (4 * parts - 1).bit_length()))
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def counted(of, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        dealt = texts.mapInArrow(of, "bucket long, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
        got = dealt.mapInArrow(trimmed(_frequent(bits, at_least)), "key long, df long").toArrow()
        key, df = got.column("key").to_numpy().astype(np.uint64), got.column("df").to_numpy()
        order = np.argsort(key)
        return key[order], df[order]

    key, df = counted(trimmed(_summaries(bits, n, least / max(1, total))), least / 2)
    return counted(trimmed(_exact(bits, n, key)), least) if len(key) else (key, df)


class Weights:
    """tf-idf weights: (1 + ln tf) * idf, up to a common factor.

    idf = 1 + damp * ln(documents / df) / ln(1 / share): 1 for a shingle of all documents,
    1 + damp for one in ``share`` of them. Rarer ones are not told apart, as only shingles
    above that share are counted. The logarithm is damped, so that large groups of near
    copies, whose common shingles are frequent too, stay similar while passages that many
    documents share count less. Weights are divided by that of the rarest shingle.
    """

    def __init__(self, key: np.ndarray, df: np.ndarray, total: int, share: float, damp: float = DAMP):
        self.key = key
        idf = lambda x: 1 + damp * np.log(np.maximum(x, share)) / np.log(share)
        self.idf = idf(df / max(1, total)) / idf(1 / max(1, total))

    def __call__(self, key: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.ones(len(key))
        more = tf > 1
        w[more] = 1 + np.log(tf[more])
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            w[hit] *= self.idf[at[hit]]
        return w


# --- consistent weighted samples --------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling.

    A sample k of a set of weights S is the key that minimises
    ln c - r (floor(ln S / r + b) - b) - r, with its floor; c and r are gamma(2, 1) and b
    uniform, drawn for each key and k from a table by hash. Equal values, as from keys
    that share an entry, go to the smaller key.
    """

    def __init__(self, k: int = BANDS * ROWS, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = 1 << TABLE_BITS
        self.k = k
        self.r = rng.gamma(2, 1, size)
        self.ln_c = np.log(rng.gamma(2, 1, size))
        self.b = rng.random(size)
        self.one = self._ordered(self.ln_c + self.r * self.b - self.r)  # at weight 1 the floor is 0
        self.odd = rng.integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _ordered(x: np.ndarray) -> np.ndarray:
        """Floats as unsigned integers of the same order, in the upper half of 64 bits."""
        i = x.astype(np.float32).view(np.uint32)
        i = np.where(i >> 31, ~i, i | np.uint32(1 << 31))
        return i.astype(np.uint64) << np.uint64(32)

    def samples(self, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, k) samples as 64-bit numbers; texts without shingles keep 0."""
        out = np.zeros((n, self.k), np.uint64)
        if not len(key):
            return out
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        odd = np.flatnonzero(weight != 1)
        ln = np.log(weight[odd])
        place = np.arange(len(key), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.k):
                j = ((key * self.odd[k]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                a = self.one[j]
                if len(odd):
                    jo = j[odd]
                    t = np.floor(ln / self.r[jo] + self.b[jo])
                    a[odd] = self._ordered(self.ln_c[jo] - self.r[jo] * (t - self.b[jo]) - self.r[jo])
                at = (np.minimum.reduceat(a | place, first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                floor = np.zeros(len(at))
                if len(odd):
                    w = weight[at]
                    jo = j[at]
                    floor = np.floor(np.log(w) / self.r[jo] + self.b[jo])
                out[doc[first], k] = mix((key[at] << np.uint64(20)) ^ (floor.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFF)))
        return out

    def bands(self, s: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each run of ``rows`` samples."""
        with np.errstate(over="ignore"):
            x = s.reshape(len(s), -1, rows)
            acc = x[:, :, 0].copy()
            for i in range(1, rows):
                acc = mix(acc) + x[:, :, i] * np.uint64(0x9E3779B97F4A7C15)
            return mix(acc)


_SIGNED = "id long, sha string, fp string, weight double, samples array<int>, keys array<long>"


def _lists(a: np.ndarray, t: pa.DataType, some: np.ndarray) -> pa.Array:
    """Rows of ``a`` as lists, empty ones where ``some`` is false."""
    width = np.where(some, a.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(a[some].reshape(-1), t))


def _fingerprints(t: Texts, doc: np.ndarray, key: np.ndarray, tf: np.ndarray) -> list[str]:
    """One string for each multiset of shingles."""
    edge = np.searchsorted(doc, np.arange(t.n + 1))
    k, f = key.astype("<u8"), tf.astype("<u4")
    return [hashlib.blake2b(k[a:b].tobytes() + f[a:b].tobytes(), digest_size=16).hexdigest() for a, b in zip(edge, edge[1:], strict=False)]


def _signed(weights: Weights, sampler: Sampler, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 384 << 10):  # so that the arrays of a sample stay in cache
            t, doc, key, tf = keyed(b.column(2).to_pylist(), n)
            w = weights(key, tf)
            s = sampler.samples(doc, key, w, t.n)
            total = np.bincount(doc, weights=w, minlength=t.n)
            some = total > 0
            short = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(_fingerprints(t, doc, key, tf), pa.string()), pa.array(total), _lists(short, pa.int32(), some), _lists(sampler.bands(s, rows).view(np.int64), pa.int64(), some)], names=["id", "sha", "fp", "weight", "samples", "keys"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (keys sorted, weights): sum of minima over sum of maxima."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    low = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return low / (float(a[1].sum() + b[1].sum()) - low)


def _vectors(weights: Weights, n: int):
    """Rows (node, vector): a text's sorted keys, then their weights, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            t, doc, key, tf = keyed(b.column(1).to_pylist(), n)
            w, edge = weights(key, tf), np.searchsorted(doc, np.arange(t.n + 1))
            made = [key[i:j].astype("<u8").tobytes() + w[i:j].astype("<f8").tobytes() for i, j in zip(edge, edge[1:], strict=False)]
            yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], names=["node", "vector"])

    return run


def _vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 16
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f8", n, 8 * n)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.fromiter((similarity(_vector(x.as_buffer()), _vector(y.as_buffer())) >= least - 1e-9 for x, y in zip(b.column(2), b.column(3), strict=True)), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def least_agreement(k: int, similar: float, miss: float = 1e-3) -> int:
    """The number of ``k`` samples in which a pair of that similarity agrees but for a share ``miss`` of pairs."""
    tail, a = 0.0, 0
    while True:
        tail += math.comb(k, a) * similar**a * (1 - similar) ** (k - a)
        if tail > miss:
            return a
        a += 1


class Run:
    """Nodes of one run of rows: one block of a bucket, or two that are compared with each other.

    ``side`` 0 and 1 are the two blocks, 2 a block that is compared with itself. Nodes of
    the commonest label are compared with other labels' nodes only.
    """

    def __init__(self, t: pa.Table, agree: int, similar: float):
        n = t.num_rows
        self.side, self.node, label, self.weight = (t.column(c).to_numpy() for c in ("side", "node", "label", "weight"))
        self.s = t.column("samples").combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.names, self.label = np.unique(label, return_inverse=True)
        self.agree, self.similar = agree, similar

    def pairs(self, now: Callable[[], np.ndarray], chunk: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, samples that agree) of pairs of labels that ``now`` tells apart, whose samples and weights allow the similarity."""
        side, label, weight, s = self.side, self.label, self.weight, self.s
        main = label == np.bincount(label).argmax()
        left, right = (side != 1), (side != 0)
        todo = [(np.flatnonzero(left & ~main), np.flatnonzero(right))]
        if side[0] != 2:
            todo.append((np.flatnonzero(left & main), np.flatnonzero(right & ~main)))
        for x, y in todo:
            if not len(y):
                continue
            wy, sy = weight[y], s[y]
            for c in range(0, len(x), chunk):
                z, at = x[c : c + chunk], now()
                ok = (at[z][:, None] != at[y]) & (np.minimum(weight[z][:, None], wy) >= (self.similar - 1e-6) * np.maximum(weight[z][:, None], wy))
                if side[0] == 2:  # each pair of nodes outside the commonest label once
                    ok &= main[y] | (y > z[:, None])
                some = np.flatnonzero(ok.any(0))
                if not len(some):
                    continue
                agreed = (s[z][:, None, :] == sy[some]).sum(-1)
                i, j = np.nonzero(ok[:, some] & (agreed >= self.agree))
                if len(i):
                    yield z[i], y[some[j]], agreed[i, j]


def _each_run(work: Callable[[pa.Table], pa.RecordBatch | None]):
    """``work`` on each run of rows (b, i, j), which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            made = work(pa.Table.from_batches(held))
            held.clear()
            if made is not None:
                yield made

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            edge = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            for i, j in zip([0, *edge], [*edge, len(keys)], strict=True):
                if j <= i:
                    continue
                if held and tuple(keys[i]) != at:
                    yield from close()
                at = tuple(keys[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from close()

    return run


def _promising(agree: int, similar: float):
    """Rows (b, node, label): the nodes of a run that have a partner of another label by their samples."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        r = Run(t, agree, similar)
        if len(r.names) < 2:
            return None
        hit = np.zeros(t.num_rows, bool)
        for i, j, _ in r.pairs(lambda: r.label):
            hit[i] = hit[j] = True
        if not hit.any():
            return None
        return pa.record_batch([t.column("b").combine_chunks().filter(pa.array(hit)), pa.array(r.node[hit]), pa.array(r.names[r.label[hit]])], names=["b", "node", "label"])

    return _each_run(work)


def _block_links(agree: int, similar: float):
    """Rows (a, b): links that join different labels' nodes of one run of rows.

    Pairs whose samples and weights allow the similarity are verified in the task, those
    that agree most first; a pair that other links of the run have joined already is
    passed over, so a run gives fewer links than it has labels.
    """

    def work(t: pa.Table) -> pa.RecordBatch | None:
        r, vector, out = Run(t, agree, similar), t.column("vector"), []
        parent = list(range(len(r.names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        label, node = r.label.tolist(), r.node.tolist()
        for i, j, agreed in r.pairs(lambda: np.array([root(x) for x in range(len(parent))])[r.label]):
            for k in np.argsort(-agreed, kind="stable").tolist():
                p, q = int(i[k]), int(j[k])
                rp, rq = root(label[p]), root(label[q])
                if rp != rq and similarity(_vector(vector[p].as_buffer()), _vector(vector[q].as_buffer())) >= similar - 1e-9:
                    parent[max(rp, rq)] = min(rp, rq)
                    out.append((min(node[p], node[q]), max(node[p], node[q])))
        if not out:
            return None
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return _each_run(work)


def _blocks(block: int) -> Column:
    """Blocks of a bucket of ``m`` nodes: of ``block`` nodes at most, and up to eight smaller ones, so that several tasks share it."""
    return F.greatest(F.ceil(F.col("m") / block), F.least(F.lit(8), F.ceil(F.col("m") / 256)))


def _runs(m: DataFrame, blocks: Column) -> DataFrame:
    """Rows of buckets dealt to runs: ``blocks`` blocks in each bucket, a run for each pair of blocks."""
    m = m.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    cols = [c for c in m.columns if c not in ("b", "blocks", "mine", "other")]
    runs = m.select("b", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), *cols)
    return runs.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")


# --- components -------------------------------------------------------------------


def join_components(labels: DataFrame, links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Labels (fp, label) after links (a, b) between nodes; a label is the least node of a component.

    Each round hooks every label to the least label that a link leads to, halves the paths
    of hooked labels by pointer jumping until each ends at a label that is not hooked, and
    drops links inside one component. So a label moves in one round only. Rows are pairs
    of keys; a join on a label that many rows have is split by adaptive execution.
    """
    work = work or Workspace(labels.sparkSession, "components")
    la, lb = labels.select(F.col("fp").alias("a"), F.col("label").alias("la")), labels.select(F.col("fp").alias("b"), F.col("label").alias("lb"))
    ends = (F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi"))
    edges = work.written(links.join(la, "a").join(lb, "b").where("la <> lb").select(*ends).distinct(), "edges")
    moves = None
    while not edges.isEmpty():
        step = edges.groupBy("hi").agg(F.min("lo").alias("to")).withColumnRenamed("hi", "label")
        before = None
        while True:
            for _ in range(3):
                up = step.select(F.col("label").alias("to"), F.col("to").alias("top"))
                step = step.join(up, "to", "left").select("label", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("went"))
            step = work.written(step, "hooks")
            work.drop(before)
            before = step
            if step.where("went").isEmpty():
                break
        step = step.select("label", "to")
        if moves is None:
            moves, gone = step, None
        else:
            up = step.select(F.col("label").alias("to"), F.col("to").alias("top"))
            known = moves.join(up, "to", "left").select("label", F.coalesce("top", "to").alias("to"))
            gone, moves = moves, work.written(known.unionByName(step), "moves")
        a = step.select(F.col("label").alias("lo"), F.col("to").alias("la"))
        b = step.select(F.col("label").alias("hi"), F.col("to").alias("lb"))
        e = edges.join(a, "lo", "left").join(b, "hi", "left").select(F.coalesce("la", "lo").alias("la"), F.coalesce("lb", "hi").alias("lb"))
        last, edges = edges, work.written(e.where("la <> lb").select(*ends).distinct(), "edges")
        work.drop(last, gone)
    if moves is None:
        return labels
    return work.written(labels.join(moves, "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "labels")


# --- the operator -----------------------------------------------------------------


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float, n: int, bands: int, rows: int, share: float, block: int, block_bytes: int, work: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """Tables (fp, o, n, size) of nodes and (id, sha, fp) of rows, and the number of rows.

    ``o``: the struct (null id, id, sha) of the first row of the node's class; ``size``:
    the rows of its class.
    """
    ship_package(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    total = d.count()
    key, df = frequent_shingles(d, max(2.0, share * total), "text", n, total)
    weights, sampler = Weights(key, df, total, share), Sampler(bands * rows)
    signed = work.written(d.select("id", F.sha2("text", 256).alias("sha"), "text").mapInArrow(trimmed(_signed(weights, sampler, rows, n)), _SIGNED), "signed")
    order = F.struct(F.col("id").isNull(), "id", "sha")
    nodes = signed.groupBy("fp").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("samples").alias("samples"), F.first("keys").alias("keys"))
    nodes = work.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    member = nodes.select("node", F.explode(F.transform("keys", lambda k, i: F.xxhash64(i, k))).alias("b"))
    bucket = work.written(member.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader")).where("m > 1"), "buckets")
    in_buckets = bucket.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot = hot_keys(bucket, "b", "m", in_buckets)
    member = work.written(dealt_join(member, bucket, "b", hot, "node"), "members")
    involved = member.select("node").distinct()
    light = work.written(nodes.join(involved, "node", "left_semi").select("node", "weight", "samples", F.col("o.id").alias("id"), F.col("o.sha").alias("sha")), "involved")
    wanted = light.select("id", "sha", "node")
    known = d.where("id is not null").withColumn("sha", F.sha2("text", 256)).join(wanted, ["id", "sha"])
    null = d.where("id is null").select("text", F.sha2("text", 256).alias("sha")).join(wanted.where("id is null").drop("id"), "sha")
    texts = known.select("node", "text").unionByName(null.select("node", "text")).dropDuplicates(["node"])
    vectors = work.written(texts.mapInArrow(trimmed(_vectors(weights, n)), "node long, vector binary"), "vectors")
    agree = least_agreement(bands * rows, similar)

    # Every node against its buckets' least nodes: by samples first, then by whole vectors.
    sampled = light.select("node", "weight", "samples")
    pairs = member.where("node <> leader").select("leader", "node").distinct()
    by_leader = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("m"))
    head = sampled.select(F.col("node").alias("leader"), F.col("weight").alias("wa"), F.col("samples").alias("sa"))
    near = dealt_join(pairs, head, "leader", hot_keys(by_leader, "leader", "m", in_buckets), "node").join(sampled, "node")
    same = F.aggregate(F.zip_with("sa", "samples", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    near = near.where((F.least("wa", "weight") >= (similar - 1e-6) * F.greatest("wa", "weight")) & (same >= agree))
    near = work.written(near.select("leader", "node"), "near")
    hot = hot_keys(near.groupBy("leader").agg(F.count(F.lit(1)).alias("m")), "leader", "m", near.count())
    va, vb = vectors.select(F.col("node").alias("leader"), F.col("vector").alias("va")), vectors.select("node", F.col("vector").alias("vb"))
    p = dealt_join(near, va, "leader", hot, "node").join(vb, "node")
    links = p.select("leader", "node", "va", "vb").mapInArrow(trimmed(_verified(similar)), "a long, b long")
    labels = join_components(light.select(F.col("node").alias("fp"), F.col("node").alias("label")), links, work)

    # Buckets that still hold several components: by samples, in blocks of bounded size.
    labelled = member.join(labels.withColumnRenamed("fp", "node"), "node").select("b", "node", "label", "m")
    still = labelled.groupBy("b").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.first("m").alias("m")).where("l0 <> l1").select("b", "m")
    still = work.written(still, "open")
    open_ = still.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    m = dealt_join(labelled.drop("m"), still, "b", hot_keys(still, "b", "m", open_), "node").join(sampled, "node")
    promising = _runs(m, _blocks(block)).drop("m").mapInArrow(trimmed(_promising(agree, similar)), "b long, node long, label long").distinct()
    # Only nodes with a promising partner get their vectors; blocks are bounded in rows and bytes.
    promising = work.written(promising, "promising")
    some = promising.join(vectors, "node").join(sampled, "node")
    size = promising.join(vectors.select("node", F.octet_length("vector").alias("bytes")), "node").groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    size = work.written(size.select("b", "m", F.greatest(_blocks(block), F.ceil(F.col("bytes") / block_bytes)).alias("parts")), "sizes")
    hot = hot_keys(size, "b", "m", size.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    runs = _runs(dealt_join(some, size, "b", hot, "node").drop("m"), F.col("parts")).drop("parts")
    old, labels = labels, join_components(labels, runs.mapInArrow(trimmed(_block_links(agree, similar)), "a long, b long"), work)

    named = nodes.select("node", "fp", "o", "n").join(labels.withColumnRenamed("fp", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = work.written(named.groupBy("label").agg(F.min("o").alias("first"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("m")), "best")
    hot = hot_keys(best, "label", "m", best.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    out = work.written(dealt_join(named, best.select("label", "first", "size"), "label", hot, "node").select("fp", F.col("first").alias("o"), "n", "size"), "classes")
    work.drop(nodes, bucket, member, light, vectors, near, old, labels, still, promising, size, best)
    return out, signed, total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, n: int = WORDS, bands: int = BANDS, rows: int = ROWS, share: float = COMMON, block: int = 8192, block_bytes: int = 24 << 20) -> DataFrame:
    """One row per row of ``docs``: id, sha (sha256 of the text), class_id, class_size, kept.

    Texts are linked when the weighted Jaccard similarity of their shingles of ``n`` words
    is ``similar`` or more; a class is a set of texts connected by links and has its
    smallest id as class id. ``kept`` marks one row of each class, the one with the
    smallest (id, sha). ``share``: shingles in more than that share of the documents are
    counted, and weigh the less the more have them (see :class:`Weights`). ``block`` and
    ``block_bytes``: nodes of a bucket, and bytes of their vectors, that a task compares.

    Null texts count as empty. Texts without words form one class; a text of fewer words
    than ``n`` is one shingle. A text of any length is read whole; a task holds the
    shingles of one text and of a block. A null id is the largest; a class of such rows
    alone has a null id. Rows that repeat are in one class, and one of rows that repeat id
    and text is kept. Other columns are not read. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "near")
    classes, signed, total = _classes(docs, id_col, text_col, similar, n, bands, rows, share, block, block_bytes, work)
    rows_ = signed.select("id", "sha", "fp").groupBy("id", "sha", "fp").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(classes, "fp", "n", total)
    out = dealt_join(rows_, classes.select("fp", "o", "size"), "fp", hot, "id")
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return out.select(F.col("id"), "sha", F.col("o.id").alias("class_id"), F.col("size").alias("class_size"), (F.col("id").eqNullSafe(F.col("o.id")) & (F.col("sha") == F.col("o.sha")) & (F.col("copy") == 1)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, n: int = WORDS, bands: int = BANDS, rows: int = ROWS, share: float = COMMON, block: int = 8192, block_bytes: int = 24 << 20) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns, whatever their names.

    Nulls, empty and long texts, repeats and empty tables are as there. The rows
    themselves are shuffled once, by id and hash of the text.
    """
    work = Workspace(docs.sparkSession, "near")
    classes, signed, _ = _classes(docs, id_col, text_col, similar, n, bands, rows, share, block, block_bytes, work)
    kept = work.written(classes.select("o").distinct().select(F.col("o.id").alias("id"), F.col("o.sha").alias("sha")), "kept")
    work.drop(classes, signed)
    return first_rows(docs, kept, F.col(f"`{id_col}`").cast("long"), F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))

"""Quality classifier: positive-unlabelled learning.

A small network is fitted by the non-negative unbiased risk of trusted positives and
unlabelled web text under an estimated class prior. It reads whole texts only: shares of
character classes, word lengths and repetition, counted over every byte of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.textnum import Texts, slices, trimmed
from strandlake.plans.session import ship_package

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~\\_=+<>{}[]",
    "quote": b"\"'`()-/",
    "line": b"\n",
    "wide": range(128, 256),
}
_LUT = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES.values(), 1):
    _LUT[list(_c)] = _i
N_FEATURES = len(_CLASSES) + 9


def _classes(texts: Texts, k: int, step: int = 1 << 18) -> np.ndarray:
    """Bytes of each text by class, counted in stretches of ``step`` bytes."""
    out = np.zeros(texts.n * k)
    for a in range(0, len(texts.buf), step):
        b = min(len(texts.buf), a + step)
        lo, hi = (int(np.searchsorted(texts.ends, x)) for x in (a, b - 1))
        size = np.minimum(texts.ends[lo : hi + 1] + 1, b) - np.maximum(texts.starts[lo : hi + 1], a)
        doc = np.repeat(np.arange(lo, hi + 1), size)
        found = np.bincount((doc - lo) * k + _LUT[texts.buf[a:b]], minlength=(hi - lo + 1) * k)
        out[lo * k : (hi + 1) * k] += found
    return out.reshape(texts.n, k)


def features(texts: Texts) -> np.ndarray:
    """One row of N_FEATURES numbers per text."""
    n, k = texts.n, len(_CLASSES) + 1
    size = (texts.ends - texts.starts).astype(float)
    share = _classes(texts, k)[:, 1:]
    share[:, list(_CLASSES).index("line")] -= 1  # the one that ends each text in the batch
    letters = share[:, 0] + share[:, 1]
    texts.words()
    h = texts.word_hashes(fold=True)
    count = np.diff(texts.words_from).astype(float)
    some = np.maximum(count, 1)
    length = texts.word_end - texts.word_start
    per = lambda x: np.bincount(texts.word_doc, weights=x, minlength=n)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (texts.word_doc[1:] == texts.word_doc[:-1])
    order = np.lexsort((h, texts.word_doc))
    fresh = np.ones(len(h))
    if len(h) > 1:
        a, d = h[order], texts.word_doc[order]
        fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(texts.word_doc[order], weights=fresh, minlength=n)
    mean = per(length) / some
    dev = np.sqrt(np.maximum(per(length.astype(float) ** 2) / some - mean**2, 0))
    x = np.column_stack(
        [
            np.sqrt(np.maximum(share, 0) / np.maximum(size, 1)[:, None]),
            np.log1p(size) / 10,
            np.log1p(count) / 10,
            np.sqrt(share[:, 1] / np.maximum(letters, 1)),
            np.log1p(mean) / 3,
            np.log1p(dev) / 3,
            per(length <= 3) / some,
            per(length >= 12) / some,
            np.sqrt(per(same) / some),
            distinct / some * np.log1p(some) / 10,
        ]
    )
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def bound_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An upper bound of the prior that is tight where some score range holds positives only.

    The share of unlabelled scores above a cut is at least the prior times that of
    positives, so the least ratio over cuts bounds the prior.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip((u / np.maximum(p, 1e-9)).min(), 0.02, 0.98))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, **options) -> float:
    """Share of positives among unlabelled rows, estimated without a negative label.

    A first network is fitted on half of the positives under a prior of one half; its
    scores of the other half and of unlabelled rows give :func:`bound_prior`.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    first = fit(positive[::2], unlabelled, 0.5, **options)
    rest = positive[1::2] if len(positive) > 1 else positive
    return bound_prior(first.logits(rest), first.logits(unlabelled))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 900, batch: int = 1024, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    While the second part of a batch is negative, its gradient is followed upwards
    instead, as in the published estimator, so that the network does not overfit it.
    Without positives or unlabelled rows the score is the prior everywhere.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, N_FEATURES))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    d = both.shape[1]
    th = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array(np.log(prior / (1 - prior)))]
    if not len(positive) or not len(unlabelled):
        th[2] = np.zeros(hidden)
        return Model(mean, scale, th[0], th[1], th[2], float(th[3]), prior)
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    m, v = [np.zeros_like(t) for t in th], [np.zeros_like(t) for t in th]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(batch, 4 * len(xp)))]
        u = xu[rng.integers(0, len(xu), min(batch, 4 * len(xu)))]
        hp, hu = np.tanh(p @ th[0] + th[1]), np.tanh(u @ th[0] + th[1])
        zp, zu = hp @ th[2] + th[3], hu @ th[2] + th[3]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        gp = prior * (-sig(-zp) * (sign > 0) - sign * sig(zp)) / len(p)
        gu = sign * sig(zu) / len(u)
        dp, du = np.outer(gp, th[2]) * (1 - hp**2), np.outer(gu, th[2]) * (1 - hu**2)
        g = [p.T @ dp + u.T @ du + decay * th[0], dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + decay * th[2], np.array(gp.sum() + gu.sum())]
        now = rate * (1 - step / (steps + 1))
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            th[i] = th[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, th[0], th[1], th[2], float(th[3]), prior)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        x = features(Texts(b.column(1).to_pylist()))
        yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["kind", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model:
    """Fit on at most ``most`` trusted positives and ``most`` unlabelled texts, those with the smallest id hashes.

    Only rows that are not held out are used. Labels other than 1 are not: the prior comes
    from positives and unlabelled texts alone (:func:`estimated_prior`). Ids that are null
    or unknown are passed over; of texts that repeat an id each counts. Without positives
    or unlabelled texts every score is the prior, 0.5.
    """
    ship_package(docs.sparkSession)
    key = F.col(f"`{id_col}`").cast("long")
    lab = labels.select(key.alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull())
    lab = lab.where(~held_out("k"))
    ids = docs.select(key.alias("k")).where(F.col("k").isNotNull() & ~held_out("k"))
    every = labels.select(key.alias("k"))
    h = F.xxhash64(F.lit(1), "k")
    pos = lab.where("y = 1").select("k").distinct().orderBy(h, "k").limit(most).withColumn("kind", F.lit(1))
    unl = ids.join(every, "k", "left_anti").distinct().orderBy(h, "k").limit(most).withColumn("kind", F.lit(0))
    chosen = pos.unionByName(unl)  # 2 * most rows of two numbers
    texts = docs.select(key.alias("k"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "k").select("kind", "text")
    rows = texts.mapInArrow(trimmed(_feature_rows), "kind int, x array<double>").toArrow()
    kind = np.array(rows.column("kind").to_pylist(), np.int64)
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T[::-1], kind))  # the fit must not depend on the order of tasks
    kind, x = kind[order], x[order]
    positive, unlabelled = x[kind == 1], x[kind == 0]
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled, **options), **options)


def score(docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``doc``, with score and predicted.

    Null texts count as empty; rows that repeat get the same score; whole texts are read,
    in stretches of bounded size; columns of any name come back inside ``doc``; an empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (pa.record_batch([b.column(0), b.column(0).field(at).cast(pa.string())], names=["doc", "text"]) for b in batches)
        for b in slices(both, 1):
            s = model.scores(features(Texts(b.column(1).to_pylist())))
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc", "score"])

    out = d.mapInArrow(trimmed(run), T.StructType([d.schema["doc"], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))

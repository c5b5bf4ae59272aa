import re

import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing
from tests.llm import edge


def fill(sizes, weights, most=3.0):
    """Share by weight; what lies above a cap is shared again until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > most * sizes[i] + 1e-12]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            open_.discard(i)
        rest = total - sum(target)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 0, 77, 3], [10] * 7, [0, 0], [1, 2, 3, 4000]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    t = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    got = {r.source: r.target for r in t}
    want = dict(zip(names, fill(sizes, [i % 3 + 1 for i in range(len(sizes))]), strict=True))
    for n, s in zip(names, sizes, strict=True):
        assert got[n] == pytest.approx(want[n] if s else 0.0)


def test_edges(spark):
    m = mixing.mixed(edge.table(spark)).collect()
    assert len(m) == len(edge.rows())
    for r in m:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.doc.text or ""))
        assert 0 <= r.copies <= 3
    assert mixing.mixed(edge.empty(spark)).count() == 0
    out = mixing.emit(edge.table(spark))
    assert out.columns == edge.table(spark).columns
    assert mixing.emit(edge.empty(spark)).count() == 0


def test_both_joins_agree_and_reruns_too(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    key = lambda: sorted((r.doc.doc_id, r.copies, r.target) for r in mixing.mixed(d).collect())
    first = key()
    assert key() == first
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key() == first
    by = {}
    for r in mixing.mixed(d).collect():
        t = by.setdefault(r.doc.source, [0, r.target])
        t[0] += r["size"] * r.copies
    assert all(abs(taken - target) < 0.12 * target for taken, target in by.values())

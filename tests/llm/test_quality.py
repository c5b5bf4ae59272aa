import zlib

import numpy as np

from strandlake.llm import quality
from strandlake.llm.textnum import Texts
from tests.llm import edge


def test_features_do_not_depend_on_the_batch():
    texts = ["Plain words, here. And more!", "", "A | B | C", "x" * 500, None, "é é é é"]
    whole = quality.features(Texts(texts))
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(Texts([t]))[0], whole[i])
    assert np.isfinite(whole).all()


def test_risk_with_separable_classes():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(0, 1, (3000, 5)), rng.normal(3.5, 1, (600, 5))
    m = quality.fit(pos[:1000], np.vstack([pos[1000:], neg]), 2000 / 2600)
    p, n = m.scores(rng.normal(0, 1, (500, 5))), m.scores(rng.normal(3.5, 1, (500, 5)))
    assert (p >= 0.3).mean() > 0.97 and (n < 0.3).mean() > 0.9
    first = quality.fit(pos[:500], np.vstack([pos[1000:], neg]), 0.5)
    assert 0.65 < quality.bound_prior(first.logits(pos[500:1000]), first.logits(np.vstack([pos[1000:], neg]))) < 0.9


def test_held_out_rule(spark):
    got = {r.doc_id: r.h for r in spark.range(300).selectExpr("id as doc_id").select("doc_id", quality.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    s = quality.score(docs, quality.train(docs, labels))
    j = s.select("doc.doc_id", "score", "predicted").join(labels, "doc_id").where(quality.held_out()).collect()
    good = [r.predicted for r in j if r.quality == 1]
    bad = [r.predicted for r in j if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None), (2, 0, 1), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality.train(edge.table(spark), labels, steps=20)
    got = quality.score(edge.table(spark), m).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(edge.empty(spark), m).count() == 0
    blank = quality.train(edge.empty(spark), labels.limit(0))
    assert blank.scores(np.zeros((1, quality.N_FEATURES)))[0] == 0.5
    m = quality.train(edge.table(spark), labels.limit(0), steps=5)
    assert quality.score(edge.table(spark), m).count() == len(edge.rows())


def test_registered_query_against_plain_python(spark, sf):
    """The whole query again over lists: who is learnt from, the prior, the fit and every row."""
    from strandlake.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = {r.doc_id: r.quality for r in labels}
    of = lambda ids: np.array(sorted((quality.features(Texts([t]))[0].tolist() for i, t in ids)))
    positive = of((d.doc_id, d.text) for d in docs if not held(d.doc_id) and label.get(d.doc_id) == 1)
    unlabelled = of((d.doc_id, d.text) for d in docs if not held(d.doc_id) and d.doc_id not in label)
    prior = quality.estimated_prior(positive, unlabelled)
    model = quality.fit(positive, unlabelled, prior)
    got = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, s = got[d.doc_id], model.scores(quality.features(Texts([d.text])))[0]
        assert r.held_out == held(d.doc_id) and abs(r.score - s) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_prior_needs_no_negative_label(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.train(docs, labels), quality.train(docs, labels.selectExpr("doc_id", "case when quality = 1 then 1 else 7 end as quality"))
    assert a.prior == b.prior and 0.5 < a.prior < 0.98
    assert np.array_equal(a.w1, b.w1)

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import mixing, near_dedup, quality
from strandlake.llm.textnum import Texts
from strandlake.plans.session import written
from tests.llm import edge
from tests.llm.test_mixing import fill
from tests.llm.test_near_dedup import brute, counted_weights


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = written(corpus_pipeline.STAGES[0][1](spark, docs, sf), "t")
    s = quality.score(docs, quality.train(docs, labels))
    assert {r.doc_id for r in kept.collect()} == {r.doc.doc_id for r in s.where("predicted = 1").collect()}

    alone = written(corpus_pipeline.STAGES[1][1](spark, kept, sf), "t")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(first.values())

    near = written(corpus_pipeline.STAGES[2][1](spark, alone, sf), "t")
    w = counted_weights([r.text for r in alone.collect()])
    sets = {}
    for r in alone.collect():
        _, _, key, tf = near_dedup.keyed([r.text])
        sets[r.doc_id] = (key, w(key, tf))
    ids = sorted(sets)
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(label.values()))

    mix = written(corpus_pipeline.STAGES[3][1](spark, near, sf), "t")
    copies = {r.doc.doc_id: r.copies for r in mixing.mixed(near).collect()}
    assert mix.count() == sum(copies.values())
    for stage in (kept, alone, near, mix):
        assert stage.columns == docs.columns

    packed = corpus_pipeline.STAGES[4][1](spark, mix, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, c in copies.items() if c}


def plain(docs, labels, fit=None):
    """The five stages over lists: documents kept, and how often each is taken."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = lambda t: quality.features(Texts([t]))[0]
    if fit is None:
        label = {r.doc_id: r.quality for r in labels}
        rows = lambda of: np.array(sorted(one(d.text).tolist() for d in docs if not held(d.doc_id) and of(d.doc_id))).reshape(-1, quality.N_FEATURES)
        positive, unlabelled = rows(lambda i: label.get(i) == 1), rows(lambda i: i not in label)
        fit = quality.fit(positive, unlabelled, quality.estimated_prior(positive, unlabelled))
    kept = [d for d in docs if fit.scores(one(d.text)[None])[0] >= 0.3]
    first = {}
    for d in sorted(kept, key=lambda d: (d.doc_id is None, d.doc_id or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d.text or ""), d)
    kept = list(first.values())
    groups = brute([(d.doc_id, d.text) for d in kept])
    least = {min((i for i in g if i is not None), default=None) for g in groups}
    kept = [d for d in kept if d.doc_id in least]
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in kept}
    names = sorted({d.source for d in kept}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[d.doc_id] for d in kept if d.source == s) for s in names]
    target = fill(sizes, [i % 3 + 1 for i in range(len(sizes))])
    taken = {}
    for d in kept:
        k = names.index(d.source)
        rate = target[k] / sizes[k] if sizes[k] else 0.0
        u = int(hashlib.sha256(f"8:{'null' if d.doc_id is None else d.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        taken[d.doc_id] = int(rate) + (u < rate - int(rate))
    return {d.doc_id: d for d in kept}, taken


def same_pieces(rows, kept, taken):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n, got, used = Counter(), Counter(), Counter()
    for i, k in taken.items():
        if k:
            n[i] = k * (len(tokenizer.encode(kept[i].text or "", add_special_tokens=False).ids) + 1)
    for r in rows:
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == n and all(x <= 4096 for x in used.values())


def test_run_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept, taken = plain(docs, spark.read.parquet(f"{sf}/labels.parquet").collect())
    same_pieces(corpus_pipeline.run(spark, sf).collect(), kept, taken)


def test_edges_stage_by_stage(spark, sf):
    docs = edge.table(spark)
    cols = docs.columns
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "edge")
        out.append(docs)
        assert docs.columns == cols or stage is corpus_pipeline.STAGES[-1][1]
    text = lambda df: sorted(re.sub(r"\s+", " ", r.text or "")[:30] for r in df.collect())
    assert set(text(out[0])) <= {re.sub(r"\s+", " ", r[1] or "")[:30] for r in edge.rows()}
    assert len({r.text for r in out[1].collect()}) == out[1].count()  # one row of each text
    ids = [r.doc_id for r in out[2].collect()]
    assert set(ids) <= {r.doc_id for r in out[1].collect()}
    assert {r.doc_id for r in out[3].collect()} <= set(ids)
    assert {r.doc_id for r in out[4].collect()} == {r.doc_id for r in out[3].collect()}
    docs = edge.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "edge")
        assert docs.count() == 0


def test_edges_without_the_classifier(spark, sf):
    """The other stages over every edge row."""
    docs = edge.table(spark)
    alone = corpus_pipeline.drop_copies(spark, docs, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in alone.collect()) == [(False, 1), (False, 2), (False, 4), (False, 7), (False, 8), (False, 9), (False, 9), (True, 0)]
    near = corpus_pipeline.drop_near_copies(spark, written(alone, "alone"), sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, 1), (False, 2), (False, 7), (False, 9), (False, 9), (True, 0)]
    mix = corpus_pipeline.mix_sources(spark, written(near, "near"), sf)
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= {1, 7, 9, None}

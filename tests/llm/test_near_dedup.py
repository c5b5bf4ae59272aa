import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import near_dedup
from tests.llm import edge


def counted_weights(texts, n=5, share=near_dedup.COMMON):
    freq = Counter()
    for t in texts:
        freq.update(set(near_dedup.keyed([t], n)[2].tolist()))
    some = sorted((k, c) for k, c in freq.items() if c >= max(2, share * len(texts)))
    return near_dedup.Weights(np.array([k for k, _ in some], np.uint64), np.array([c for _, c in some], np.int64), len(texts), share)


def brute(rows, n=5, similar=0.8, weights=None):
    """Classes by comparing all texts, with frequencies counted over all of them."""
    weights = weights or counted_weights([t for _, t in rows], n)
    sets = []
    for _, t in rows:
        _, _, key, tf = near_dedup.keyed([t], n)
        sets.append((key, weights(key, tf)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i][0]) == len(sets[j][0]) == 0
            if same or len(sets[i][0]) and len(sets[j][0]) and near_dedup.similarity(sets[i], sets[j]) >= similar:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def classes(df):
    got, groups = df.collect(), defaultdict(list)
    for r in got:
        groups[r.class_id if r.class_id is not None else ("null", r.sha)].append(r)
    for c, rs in groups.items():
        assert sum(r.kept for r in rs) == 1 and all(r.class_size == len(rs) for r in rs)
        assert isinstance(c, tuple) or c == min(r.id for r in rs if r.id is not None)
    return sorted((sorted((r.id for r in rs), key=str) for rs in groups.values()), key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        if g % 4 == 0:
            base = base[:80] + passage
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block, size in ((4096, 24 << 20), (3, 24 << 20), (4096, 3000)):
        assert classes(near_dedup.near_duplicates(df, block=block, block_bytes=size)) == brute(rows)


def test_frequencies_are_exact_from_the_least_count_up(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    for _, t in rows:
        want.update(set(near_dedup.keyed([t])[2].tolist()))
    for least in (2, 5, 9):
        key, freq = near_dedup.frequent_shingles(df.repartition(7), least)
        assert dict(zip(key.tolist(), freq.tolist(), strict=True)) == {k: c for k, c in want.items() if c >= least}


def test_common_shingles_weigh_less(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    w = counted_weights([t for _, t in rows])
    common = w.key[np.argmax(w.idf * -1)]
    assert w(np.array([common, 1], np.uint64), np.array([1, 1]))[0] < 1 == w(np.array([1], np.uint64), np.array([1]))[0]
    by_df = dict(zip(near_dedup.frequent_shingles(df, 2)[1].tolist(), w.idf.tolist(), strict=True))
    assert [by_df[k] for k in sorted(by_df)] == sorted(by_df.values(), reverse=True)
    total, share = len(rows), near_dedup.COMMON
    for f, v in by_df.items():
        assert v == pytest.approx((3 + np.log(total / f) / np.log(1 / share)) / (3 + np.log(total) / np.log(1 / share)))


def test_rare_shingles_of_large_tables_are_alike():
    w = near_dedup.Weights(np.array([5], np.uint64), np.array([10_000]), 1_000_000, 0.001)
    assert w(np.array([5, 6], np.uint64), np.array([1, 1])).tolist() == pytest.approx([(3 + 2 / 3) / 4, 1])


def test_recall_on_documents(spark):
    """All true pairs by brute force over an inverted index of whole texts, against the classes found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    w = counted_weights([t for _, t in rows])
    sets, having = [], defaultdict(list)
    for i, (_, t) in enumerate(rows):
        _, _, key, tf = near_dedup.keyed([t])
        sets.append((key, w(key, tf)))
        for k in key.tolist():
            having[k].append(i)
    seen, pairs = set(), []
    for h in having.values():
        for a in range(len(h)):
            for b in range(a):
                if (h[b], h[a]) not in seen:
                    seen.add((h[b], h[a]))
                    if near_dedup.similarity(sets[h[a]], sets[h[b]]) >= 0.8:
                        pairs.append((rows[h[b]][0], rows[h[a]][0]))
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.98 * len(pairs)
    # and no class holds more than brute force joins
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(find(i) == find(c) for i, c in got.items())


def test_sampling_agrees_with_similarity():
    rng = np.random.default_rng(1)
    s = near_dedup.Sampler(400, seed=9)
    for _ in range(6):
        keys = np.unique(rng.integers(1, 1 << 44, 300, dtype=np.uint64))
        wa, wb = np.exp(rng.normal(0, 0.5, len(keys))), np.exp(rng.normal(0, 0.5, len(keys)))
        wb[: len(keys) // 3] = wa[: len(keys) // 3]
        doc, key, w = np.repeat([0, 1], len(keys)), np.tile(keys, 2), np.concatenate([wa, wb])
        got = s.samples(doc, key, w, 2)
        want = near_dedup.similarity((keys, wa), (keys, wb))
        assert abs((got[0] == got[1]).mean() - want) < 0.1


def test_components(spark):
    rng = random.Random(2)
    nodes = [f"{i:04d}" for i in range(300)]
    links = [(nodes[i], nodes[i + 1]) for i in range(0, 120)] + [tuple(sorted(rng.sample(nodes[150:], 2))) for _ in range(90)]
    labels = near_dedup.join_components(spark.createDataFrame([(n, n) for n in nodes], "fp string, label string"), spark.createDataFrame(links, "a string, b string"))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r.fp: r.label for r in labels.collect()} == {n: find(n) for n in nodes}


def test_edges(spark):
    got = near_dedup.near_duplicates(edge.table(spark))
    assert got.count() == len(edge.rows())
    by = {r.id: r.class_id for r in got.where("id is not null and id <> 9").collect()}
    assert by[1] == by[5] == 1 and by[2] == by[3] == by[4] == 2 and by[7] == by[8] == 7
    assert sorted((r.id, r.class_id) for r in got.where("id = 9").collect()) == [(9, 9)] * 3
    assert classes(near_dedup.near_duplicates(edge.table(spark).where("doc_id <> 9")))
    kept = near_dedup.keep_one(edge.table(spark))
    assert kept.columns == edge.table(spark).columns
    assert sorted((r.text or "")[:12].strip() for r in kept.collect()) == sorted(["a b c", "", "only null id", "lorem ipsum", "same row twi", "same id, oth"])
    assert near_dedup.near_duplicates(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_hot_group_of_near_copies(spark, n):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 == 0 else [f"x{rng.randrange(10**6)}" for _ in range(40)]
        if i % 3 == 0:
            w[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    hot = got.where("class_size > 1").collect()
    assert len(hot) == n // 3 and {r.class_id for r in hot} == {0}


@pytest.mark.parametrize("n", [9, 10, 121])
def test_long_paths_give_each_node_once(spark, n):
    nodes = [f"{i:04d}" for i in range(n)]
    labels = near_dedup.join_components(spark.createDataFrame([(x, x) for x in nodes], "fp string, label string"), spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a string, b string"))
    assert sorted((r.fp, r.label) for r in labels.collect()) == [(x, nodes[0]) for x in nodes]


def test_near_copies_with_null_ids(spark):
    copies = lambda c, n: [" ".join([*(f"{c}{i}" for i in range(200)), f"end{j}"]) for j in range(n)]
    rows = [(None if j else 1, t) for j, t in enumerate(copies("a", 3))] + [(None, t) for t in copies("b", 3)] + [(None, "another text without copies")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.class_size, r.class_id or 0) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 0), *[(3, 0)] * 3, *[(3, 1)] * 3]
    assert sorted(r.text[:2] for r in near_dedup.keep_one(df).collect()) == ["a0", "an", "b0"]

import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import exact_dedup
from tests.llm import edge


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    out = []
    for t, ids in by.items():
        keep = min((i for i in ids if i is not None), default=None)
        taken = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=8), st.one_of(st.none(), st.integers(0, 9))), max_size=40))
def test_trie_is_a_dictionary(items):
    trie, want = exact_dedup.PatriciaTrie(), {}
    for k, i in items:
        k = k.encode()
        trie.insert(k, i)
        o, n = want.get(k, (None, 0))
        want[k] = (i if o is None else o if i is None else min(o, i), n + 1)
    assert {k: (o, n) for k, o, n in trie.drain()} == want
    assert trie.size == 0


def test_spill_keeps_all():
    rng, trie, got, want = random.Random(1), exact_dedup.PatriciaTrie(), {}, {}
    for _ in range(3000):
        k = bytes(rng.choices(b"abc", k=rng.randint(0, 6)))
        trie.insert(k, 1)
        want[k] = want.get(k, 0) + 1
        if trie.size > 20_000:
            for key, _, n in trie.spill():
                got[key] = got.get(key, 0) + n
    for key, _, n in trie.drain():
        got[key] = got.get(key, 0) + n
    assert got == want


def test_edges_against_brute_force(spark):
    for budget in (64 << 20, 1000):
        got = exact_dedup.exact_dedup(edge.table(spark), trie_bytes=budget).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in edge.rows()])
    assert exact_dedup.exact_dedup(edge.empty(spark)).count() == 0


def test_stage_keeps_columns_and_one_row_each(spark):
    d = edge.table(spark)
    kept = exact_dedup.keep_owners(d)
    assert kept.columns == d.columns
    assert sorted((norm(r.text) for r in kept.collect())) == sorted({norm(r[1]) for r in edge.rows()})
    assert exact_dedup.keep_owners(edge.empty(spark)).count() == 0


def test_hot_group(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot  text' else concat('t ', id) end as text")
    got = exact_dedup.exact_dedup(d)
    hot = got.where("group_size > 1").collect()
    assert len(hot) == 1334 and {r.keep_id for r in hot} == {0} and sum(r.kept for r in hot) == 1
    assert got.count() == 4000

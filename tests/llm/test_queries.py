"""The registered queries over whole tables: by SQL where there is some, else by brute force.

Those of op1, op2, op4, op5 and op10 are in the tests of their operators.
"""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from strandlake.llm import queries
from tests.llm.test_near_dedup import brute
from tests.test_entry import TABLES, rows


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_near_dedup_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op3_near_dedup(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(c, key=str) for c in classes.values()) == sorted(brute(docs))
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == len(classes[r.class_id]) for r in got)


def test_packing_against_the_tokenizer(spark, sf):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_packing(spark, sf).collect()
    taken, used = Counter(), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == taken[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) // 4
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        taken[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert taken == {i: len(b) // 4 for i, b in ids.items()}
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    assert sum(taken.values()) > 0.9 * 4096 * (len(used) - 8)

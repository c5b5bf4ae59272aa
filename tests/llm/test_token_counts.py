import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import token_counts
from tests.llm import edge


@pytest.fixture(scope="module")
def count():
    return token_counts.counter(*token_counts.vocabulary())


ALPHABET = st.sampled_from(list("ab '.1\n\té  ") + ["'ll", "  ", "word ", "<|endoftext|>", "日", "\x1c", "\x85"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80), st.lists(ALPHABET, max_size=6).map("".join)), max_size=6), st.integers(1, 12))
def test_edits_equal_a_full_count(count, text, edits, least):
    tree = token_counts.SegmentTree(text, count, least)
    assert tree.total == count([text])[0]
    for a, b, new in edits:
        a, b = sorted((min(a, len(text)), min(b, len(text))))
        text = text[:a] + new + text[b:]
        tree.replace(a, b, new)
        assert tree.text() == text and len(tree) == len(text) and tree.total == count([text])[0]


def test_only_touched_runs_are_encoded(count):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20_000))
    tree = token_counts.SegmentTree(text, count)
    tree.replace(50_000, 50_010, "<email>")
    assert 0 < tree.encoded < 4000


def test_edges_and_mails(spark, count):
    got = token_counts.count_with_edits(edge.table(spark), token_counts.mail_edits).collect()
    assert sorted(r.n_tokens for r in got) == sorted(count([t or ""])[0] for _, t, *_ in edge.rows())
    assert token_counts.count_with_edits(edge.empty(spark)).count() == 0
    text = "Write to a.b+c@mail6.example.com, x@y or é@b.co@c.de @ @@ z@z.zz"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = token_counts.count_with_edits(df, token_counts.mail_edits).first()
    want = token_counts.MAIL.sub("<email>", text)
    assert (r.n_edits, r.n_tokens_edited, r.n_chars_edited) == (len(token_counts.MAIL.findall(text)), count([want])[0], len(want))


def test_edit_table(spark, count):
    docs = edge.table(spark)
    edits = spark.createDataFrame([(1, 2, 0, 1, "second"), (1, 1, 0, 1, "first"), (3, 1, 0, 9, "into an empty text"), (99, 1, 0, 0, "nobody"), (5, 1, -4, 900, None)], "doc_id long, seq int, start long, end long, text string")
    got = {r.id: r for r in token_counts.count_with_edits(docs.where("doc_id < 9"), edits).collect()}
    assert got[1].n_tokens_edited == count(["secondirst b c"])[0] and got[1].n_edits == 2
    assert got[3].n_tokens_edited == count(["into an empty text"])[0]
    assert got[5].n_tokens_edited == 0 and got[7].n_edits == 0
    assert token_counts.count_with_edits(docs.where("doc_id < 9"), edits.withColumn("text", F.col("text"))).count() == 7


def test_large_inserts_are_split(count):
    tree = token_counts.SegmentTree("a few words here", count)
    big = " ".join(f"word{i}" for i in range(40_000))
    tree.replace(6, 6, big)
    before = tree.encoded
    tree.replace(150_000, 150_001, "x")
    assert tree.encoded - before < 3000
    assert tree.total == count([tree.text()])[0]
    tree.replace(10, len(tree) - 10, "")  # most runs are empty now
    assert len(tree.runs) < 20 and tree.total == count([tree.text()])[0]


def test_text_without_spaces_has_runs(count):
    rng = random.Random(1)
    text = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=120_000))
    tree = token_counts.SegmentTree(text, count)
    assert len(tree.runs) > 150 and tree.total == count([text])[0]
    tree.replace(60_000, 60_001, "!")
    assert tree.encoded < 3000 and tree.total == count([tree.text()])[0]


def test_byte_level_pattern():
    assert token_counts.vocabulary()[1] == token_counts.BYTE_LEVEL


def test_trees_outlive_the_job(spark, count, tmp_path):
    docs = edge.table(spark).where("doc_id < 9")
    token_counts.build_trees(docs).write.parquet(str(tmp_path / "trees"))
    trees = spark.read.parquet(str(tmp_path / "trees"))
    edits = spark.createDataFrame([(7, 1, 100_000, 100_010, "changed"), (1, 1, 0, 1, "first")], "doc_id long, seq int, start long, end long, text string")
    token_counts.edit_trees(trees, edits).write.parquet(str(tmp_path / "edited"))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "edited")).collect()}
    want = edge.LONG[:100_000] + "changed" + edge.LONG[100_010:]
    assert got[7].text == want and got[7].n_tokens_edited == count([want])[0] and 0 < got[7].chars_encoded_again < 4000
    assert got[8].chars_encoded_again == 0 and got[1].text == "first b c"
    again = {r.id: r for r in token_counts.edit_trees(spark.read.parquet(str(tmp_path / "edited")), edits).collect()}
    assert again[7].n_tokens == got[7].n_tokens_edited and again[7].n_tokens_edited == count([want[:100_000] + "changed" + want[100_010:]])[0]


def test_registered_query(spark, sf, count):
    from strandlake.llm import queries

    got = {r.doc_id: r for r in queries.op10_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, new = got[d.doc_id], token_counts.MAIL.sub("<email>", d.text)
        assert (r.n_tokens, r.n_tokens_edited) == tuple(count([d.text, new]))
        assert (r.n_chars, r.n_chars_edited, r.n_edits) == (len(d.text), len(new), len(token_counts.MAIL.findall(d.text)))

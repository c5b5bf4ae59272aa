import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandlake.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "<|turn:user|>\nx<|end|>\n", "\\1| \\0 \\\\ <| <s> <<SYS>> \\2INST]", "", "é日本\n[INST", "<|end|>\n", "[/INST][INST]</s>"]


def rows():
    out = [(1, t, ["system", "user", "assistant"][t % 3], TRICKY[t % len(TRICKY)]) for t in range(14)]
    out += [(2, 0, "user", "only a user"), (3, 0, "assistant", "first"), (3, 1, "assistant", None), (4, 1, None, "no role"), (4, None, "role\nwith <|end|>\n feed", "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, 0, "user", "r"), (5, 0, "user", "r"), (5, 1, "assistant", "z" * 50_000)]
    return out


def test_digests_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    ex = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(ex).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows():
        by[c].append((t is not None, t or 0, r or "", x or ""))
    chars = {r.conv_id: r.n for r in ex.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in ts).encode()).hexdigest()
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(ts), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars[c])
    assert len(got) == len(by)


def test_each_reply_is_one_example(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").where("conv_id = 1")
    ex = chat.examples(df).orderBy("example").collect()
    assert [e.n_turns for e in ex] == [3, 6, 9, 12, 14] and [e.loss_start < 0 for e in ex] == [False] * 4 + [True]
    for a, b in zip(ex, ex[1:], strict=False):
        assert b.formatted.startswith(a.formatted)
    for e in ex[:4]:
        assert e.formatted[e.loss_start + e.loss_chars :] == chat.END


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.examples(df))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()

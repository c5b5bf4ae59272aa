"""Chat formatting: prefix-target expansion with built-in functions only.

Every assistant turn becomes an example of its own: all preceding turns are context,
only that reply is trainable. A conversation whose last turn is not an assistant's
gives one more example, with nothing trainable, so that no turn is lost.

The template is ``<|turn:ROLE|>\\nTEXT<|end|>\\n``. Inside roles and texts a backslash
becomes ``\\0``, a ``<`` or ``[`` that opens a control string ``\\1`` or ``\\2``, and,
in roles, a line feed ``\\3``; each code stands alone, so replacing them in turn gives
the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that other code gives meaning to, apart from this template's own.
CONTROL = ("<s>", "</s>", "<|", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_ANGLE = "<(?=\\||/?s>|<SYS>>|</SYS>>)"
_SQUARE = "\\[(?=/?INST\\])"
HEAD, MID, END = "<|turn:", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    text = F.regexp_replace(text, _ANGLE, "\\\\1")
    return F.regexp_replace(text, _SQUARE, "\\\\2")


def unescape(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), [("\\3", "\n"), ("\\2", "["), ("\\1", "<"), ("\\0", "\\")], text)


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_turns, formatted, loss_start, loss_chars.

    The loss mask covers ``loss_chars`` code points of ``formatted`` from ``loss_start``
    (0-based); -1 and 0 where nothing is trainable. Null texts and roles are empty; a
    null conversation id is a conversation of its own; turns that tie are ordered by role,
    then text, and repeated rows stay. Texts of any length are whole, up to what one row
    may hold; columns of other names are not read. An empty table gives an empty result. One
    conversation is one training document, so its turns are brought together.
    """
    s = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), s(role_col).alias("role"), s(text_col).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    piece = lambda x: F.struct(
        (x["role"] == trainable).alias("loss"),
        F.concat(F.lit(HEAD), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\3")), F.lit(MID)).alias("head"),
        escape(x["text"]).alias("body"),
    )
    conv = conv.select("conv_id", F.transform("ts", piece).alias("ps"))
    n = F.size("ps")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("ps", i)["loss"] | (i == n))
    conv = conv.select("conv_id", "ps", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("ps", F.col("n_turns"))
    before = F.array_join(F.transform(F.slice("ps", F.lit(1), F.col("n_turns") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    ready = conv.select("conv_id", "example", "n_turns", F.concat(before, last["head"]).alias("context"), last["body"].alias("body"), last["loss"].alias("loss"))
    return ready.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("loss"), F.length("context")).otherwise(-1).alias("loss_start"),
        F.when(F.col("loss"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def digests(ex: DataFrame) -> DataFrame:
    """What a reader gets back from the examples, per conversation.

    Turns are parsed from the example that holds all of them, trained text from each
    example's mask; both are unescaped.
    """
    masked = F.when(F.col("loss_start") >= 0, unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))).otherwise(F.lit(""))
    ex = ex.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("chars"), F.struct("n_turns", "formatted").alias("whole"), F.struct("example", masked.alias("text")).alias("masked"))
    per = ex.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list("masked")).alias("masked"), F.sum("chars").alias("formatted_chars"))
    parts = F.split(F.col("whole.formatted"), "<\\|end\\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        head = F.instr(p, MID)
        role = F.substr(p, F.lit(len(HEAD) + 1), head - F.lit(len(HEAD) + 1))
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substr(p, head + F.lit(len(MID)))), F.lit("\n"))

    loss = F.array_join(F.transform("masked", lambda m: m["text"]), "")
    return per.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(parts, turn), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting by prefix-target expansion, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import named

#: Fixed values of the template: a turn is <turn ROLE>TEXT</turn> and a line feed. The three characters that markers
#: need are written as a backslash and a letter inside roles and texts, so neither can hold a marker.
OPEN, BODY, CLOSE = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """The formatted conversations: one row for each turn, and in the rows of target turns one training example each.

    conv_id, turn_no (from 1 in order of turn; of equal turns by role and text), segment (the formatted turn), start and
    stop (its span in the conversation's stream, the segments one after another). In rows of the target role also:
    example_no, and the example's spans in the stream: its text is [0, stop), all preceding turns and this one, and
    only [loss_start, loss_stop), the reply, is trainable. Else these are null.

    Every example's context is a prefix of its conversation's stream, so the stream is kept once and examples are spans:
    the output grows with the input and not with the square of a conversation's turns. ``render`` writes examples out.
    Null roles and texts count as empty; turns of null conversations form one. An empty table gives no rows.
    """
    order = ["turn", "role", "text"]
    rows = turns.select(
        named(turns, conv_col).cast("long").alias("conv_id"), named(turns, turn_col).cast("long").alias("turn"),
        F.coalesce(named(turns, role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(named(turns, text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("segment", F.concat(head, escape(F.col("text")), F.lit(CLOSE))).withColumn("target", F.col("role") == target_role)
    by_turn = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.row_number().over(by_turn).alias("turn_no"), F.sum(F.length("segment").cast("long")).over(so_far).alias("stop"), F.sum(F.col("target").cast("long")).over(so_far).alias("nth"))
    start = F.col("stop") - F.length("segment")
    only = lambda value: F.when(F.col("target"), value)
    return rows.select(
        "conv_id", "turn_no", "segment", start.alias("start"), "stop",
        only(F.col("nth")).alias("example_no"), only(start + F.length(head)).alias("loss_start"), only(F.col("stop") - len(CLOSE)).alias("loss_stop"),
    )


def _written(formatted: DataFrame) -> DataFrame:
    """``formatted`` with prompt and reply: in examples the whole context and the trainable text, written out; else null."""
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = formatted.withColumn("stream", F.when(F.col("example_no").isNotNull(), F.array_join(F.collect_list("segment").over(before), "")))
    return rows.withColumns({"prompt": F.expr("substring(stream, 1, cast(loss_start as int))"), "reply": F.expr("substring(stream, cast(loss_start as int) + 1, cast(loss_stop - loss_start as int))")}).drop("stream")


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, example_no, prompt, reply): every example written out, ready for a trainer.

    Each row holds its whole context, so this grows with the square of a conversation's turns; it suits conversations of
    ordinary length, and longer ones are better read by their spans. Null roles and texts were written as empty ones;
    a conversation without a turn of the target role, and an empty table, give no rows.
    """
    return _written(formatted).where("example_no is not null").select("conv_id", "example_no", "prompt", "reply")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the role and the text of its segments and, in examples, prompt, reply and the trainable text of the written example.

    Every text comes back as it was, a null one as empty. An empty table gives no rows.
    """
    parts = F.split("segment", BODY, -1)
    role, text = F.substr(parts[0], F.lit(len(OPEN) + 1)), parts[1]
    return _written(formatted).withColumns({"role": unescape(role), "text": unescape(F.substr(text, F.lit(1), F.length(text) - (len(CLOSE) - 2))), "loss": unescape(F.col("reply"))})


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted rows: turns, digests of all turns and of all trainable text, and sizes.

    The trainable text and the sizes of examples are taken from the examples written out, each with its whole context.

    formatted_chars is the length of all examples, each with its context, and of the whole stream once more where turns
    follow the last example, which then are in no example.
    """
    example = F.length("prompt").cast("long") + F.length("reply") + len(CLOSE)
    turn = F.struct("turn_no", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss")
    rows = read_back(formatted).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"),
        F.coalesce(F.sum(F.length("loss").cast("long")), F.lit(0)).alias("loss_chars"),
        F.coalesce(F.sum(example), F.lit(0)).alias("in_examples"),
        F.sum(F.length("segment").cast("long")).alias("last"), F.coalesce(F.max(example), F.lit(0)).alias("last_example"),
    )
    sha = lambda name: F.sha2(F.array_join(F.transform("turns", lambda x: x[name]), "").cast("binary"), 256)
    rest = F.when(F.col("last") > F.col("last_example"), F.col("last")).otherwise(0)
    return rows.select("conv_id", "n_turns", sha("turn").alias("turns_sha256"), "loss_chars", sha("loss").alias("loss_sha256"), (F.col("in_examples") + rest).alias("formatted_chars"))

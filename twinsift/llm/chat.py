"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the formatted conversation
up to and including that turn, of which only the reply is trainable (``loss_start``
and ``loss_length`` mark it, in code points of ``text``). A conversation that
does not end with an assistant turn gets one more example without a trainable
part, so that the output holds every turn.

Template of a turn: ``<turn role=ROLE>\\nTEXT\\n</turn>\\n``. Texts and roles are
escaped reversibly: a backslash becomes ``\\b``, ``<`` becomes ``\\l``, and in
roles a line feed becomes ``\\e``; so no text can hold a control string.

Turns are ordered by turn number, then role, then text; repeated rows stay.
Null texts and roles are empty; rows with a null conversation id form one
conversation. An example holds its whole context by definition, so a
conversation's turns meet in one row; conversations are independent of each other.
Texts are taken whole, however long. An empty table gives no examples. Only the named columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<turn role=", "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\e"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\e"), F.lit("\n")))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Examples ``(conv_id, example, last, text, loss_start, loss_length)``; ``last`` marks a conversation's last example."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    head = F.concat(F.lit(_OPEN), escape_role(F.col("role")), F.lit(">\n"))
    shaped = turns.select("conv_id", F.struct("turn", "role", "text", F.concat(head, body, F.lit(_CLOSE)).alias("piece"), F.length(head).alias("lead"), F.length(body).alias("size")).alias("t"))
    whole = shaped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    running = lambda got, t: F.concat(got, F.array(F.coalesce(F.get(got, F.size(got) - 1), F.lit(0)) + F.length(t["piece"])))
    ends = F.aggregate("ts", F.array().cast("array<int>"), running)
    laid = whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("full"), "ts", ends.alias("ends"))
    n = F.size("ts")
    marks = F.filter(
        F.transform("ts", lambda t, i: F.struct(i.alias("example"), F.get("ends", i).alias("end"), (t["role"] == trained_role).alias("trained"), (i == n - 1).alias("last"), t["lead"].alias("lead"), t["size"].alias("size"), F.length(t["piece"]).alias("length"))),
        lambda m: m["trained"] | m["last"],
    )
    examples = laid.select("conv_id", "full", F.explode(marks).alias("m"))
    return examples.select(
        "conv_id", F.col("m.example").alias("example"), F.col("m.last").alias("last"),
        F.left("full", F.col("m.end")).alias("text"),
        F.when(F.col("m.trained"), F.col("m.end") - F.col("m.length") + F.col("m.lead")).alias("loss_start"),
        F.when(F.col("m.trained"), F.col("m.size")).otherwise(F.lit(0)).alias("loss_length"),
    )


def turns_of(text: Column) -> Column:
    """Turns ``array<struct<role, text>>`` read back from a formatted text."""
    pieces = F.filter(F.split(text, _CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.substr(head, F.lit(len(_OPEN) + 1), F.length(head) - len(_OPEN) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """Unescaped text under the loss mask; empty without one."""
    return F.coalesce(unescape(F.substr(text, start + 1, length)), F.lit(""))

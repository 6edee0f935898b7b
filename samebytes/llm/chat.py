"""Chat formatting with relational and array expressions only.

Turns of a conversation are collected as structs and sorted. Runs of adjacent turns with one
role are merged into one block, and blocks are concatenated:

    <|turn|>role\\ntext<|join|>text<|end|>\\n

`<|join|>` keeps merged texts apart, so that the turns can be read back. Control strings in
texts and roles are escaped: a backslash becomes `\\0`, and `\\1` is put behind the first
character of a control string, which therefore never occurs in an escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, JOIN, END = "<|turn|>", "<|join|>", "<|end|>\n"

#: Strings that no text may contain unescaped: this template's and those of common others.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Text without control strings; `unescape` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\1{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so it may not contain one."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def _total(lengths: Column, first: Column) -> Column:
    """Sum of the first entries of an array of lengths."""
    return F.aggregate(F.slice(lengths, 1, first), F.lit(0), lambda a, x: a + x)


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: `formatted` and `loss_spans`.

    `loss_spans` holds (start, end) in characters of `formatted`, one span for every text of
    `learn_role`, in order. Null texts and roles count as empty. Turns are sorted by turn, then
    role, then text, nulls first, so ties and repeated rows have one order. Rows without
    conversation form one conversation with a null id. Other columns are left out. A
    conversation is one record by nature and has to fit into a task; nothing else is gathered.
    """
    entry = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(entry)).alias("_turns"))
    count = F.size("_turns")
    starts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]),
    )
    runs = F.transform(
        F.col("_starts"),
        lambda s, k: F.struct(
            F.get("_turns", s)["role"].alias("role"),
            F.transform(
                F.slice("_turns", s + 1, F.coalesce(F.get("_starts", k + 1), count) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    blocks = F.transform(
        F.col("_runs"),
        lambda r: F.concat(
            F.lit(TURN), escape_role(r["role"]), F.lit("\n"), F.array_join(r["texts"], JOIN), F.lit(END)
        ),
    )
    lengths = F.transform(F.col("_blocks"), lambda b: F.length(b))

    def run_spans(run: Column, k: Column) -> Column:
        head = _total(F.col("_lengths"), k) + len(TURN) + F.length(escape_role(run["role"])) + 1
        sizes = F.transform(run["texts"], lambda t: F.length(t))
        begin = lambda j: (head + _total(sizes, j) + j * len(JOIN)).cast("long")
        spans = F.transform(
            run["texts"],
            lambda t, j: F.struct(begin(j).alias("start"), (begin(j) + F.length(t)).alias("end")),
        )
        return F.when(run["role"] == learn_role, spans).otherwise(F.slice(spans, 1, 0))

    return (
        sorted_turns.withColumn("_starts", starts)
        .withColumn("_runs", runs)
        .withColumn("_blocks", blocks)
        .withColumn("_lengths", lengths)
        .select(
            conv,
            F.array_join("_blocks", "").alias("formatted"),
            F.flatten(F.transform("_runs", run_spans)).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of (role, text), one per original turn."""
    blocks = F.split(formatted, r"<\|end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def texts(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block))
        name = unescape_role(F.substring(role, F.lit(len(TURN) + 1), F.length(role)))
        return F.transform(
            F.split(body, r"<\|join\|>", -1),
            lambda t: F.struct(name.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, texts))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, in order."""
    return F.transform(
        spans,
        lambda s: unescape(
            F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        ),
    )

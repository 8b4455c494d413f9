"""Chat formatting in budgeted windows, with DataFrame functions only.

The turns of a conversation are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Prefix sums
of turn tokens cut the conversation into spans of whole turns; each later window repeats the
system turn and the last turns that fit ``history`` tokens. Only assistant texts that no earlier
window had are under the loss mask, so each is a target once.

Control strings inside roles and texts are escaped: backslash is written ``\\s``, ``<|`` is
``<\\p`` and, in roles, a line break is ``\\n``; every backslash in the output starts an escape,
so undoing them in the opposite order restores the text.

Defined results: a null role or text counts as empty; turns with equal number are ordered by
role, then text, and repeated rows are all kept; a null turn number comes first; a null conv_id
is a conversation of its own; a turn longer than the budget is a window by itself, whole. Columns
other than the four named ones are ignored. A conversation is one row, as its digests need it in
order; conversations never meet each other in a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that the marks of a turn count as.
TURN_TOKENS = 4
WORDS = "[^ \t\n\r]+"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    if role:
        c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("<\\p"), F.lit("<|"))
    if role:
        c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, budget: int = 384, history: int = 96) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row for each window.

    Columns: conv_id, win, formatted, loss_spans (array of start and length in code points of
    ``formatted``), n_repeated and n_new (turns), n_tokens. ``history`` tokens of the budget are
    kept for repeated turns; what the system turn leaves goes to new turns.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    tok = (F.regexp_count(text, F.lit(WORDS)) + TURN_TOKENS).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), tok.alias("tok"))
    # tokens up to each turn, by one sort of the conversation, which the collection below is dealt by too
    upto = F.sum("tok").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    conv = rows.withColumn("upto", upto).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "upto", "role", "text", "tok"))).alias("t"))
    conv = conv.select(
        "conv_id",
        "t",
        F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0).alias("sys"),
        # prefix[i]: tokens of the turns before turn i
        F.concat(F.array(F.lit(0).cast("long")), F.transform("t", lambda x: x["upto"])).alias("prefix"),
    ).withColumn("cap", F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("sys") == 1, F.col("t")[0]["tok"]).otherwise(0)))
    # a span ends before the turn with which it would pass the cap
    conv = conv.withColumn(
        "starts",
        F.expr(
            "aggregate(if(size(t) > sys, sequence(sys, size(t) - 1), cast(array() as array<int>)), array(sys), (acc, i) ->"
            " if(i > element_at(acc, -1) and prefix[i + 1] - prefix[element_at(acc, -1)] > cap, concat(acc, array(i)), acc))"
        ),
    )
    # windows are cut out before they become rows, so that no row carries the whole conversation; no more turns fit the history than
    # have the marks' tokens alone
    back = f"if(win = 0, 0, size(filter(sequence(greatest(sys, first - {history // TURN_TOKENS + 1}), first - 1), j -> prefix[first] - prefix[j] <= {history})))"
    cut = (
        f"transform(starts, (first, win) -> named_struct('win', win, 'seen', if(win = 0, slice(t, 1, 0), concat(slice(t, 1, sys), slice(t, first - {back} + 1, {back}))),"
        " 'new', if(win = 0, slice(t, 1, coalesce(get(starts, win + 1), size(t))), slice(t, first + 1, coalesce(get(starts, win + 1), size(t)) - first))))"
    )
    win = conv.select("conv_id", F.explode(F.expr(cut)).alias("w")).select("conv_id", "w.*")
    shown = F.transform(
        F.concat("seen", "new"),
        lambda x: F.struct(
            F.concat(F.lit(START), escape(x["role"], role=True), F.lit("\n")).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"] == "assistant").alias("target"),
            x["tok"].alias("tok"),
        ),
    )
    win = win.select("conv_id", "win", F.size("seen").alias("n_repeated"), F.size("new").alias("n_new"), shown.alias("m"))
    return win.select(
        "conv_id",
        "win",
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.expr(
            "aggregate(sequence(1, size(m)), struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as spans), (acc, i) -> struct("
            f" acc.at + char_length(m[i - 1].head) + char_length(m[i - 1].body) + {len(END)} as at,"
            " if(i > n_repeated and m[i - 1].target, concat(acc.spans, array(struct(acc.at + char_length(m[i - 1].head) as start, char_length(m[i - 1].body) as length))), acc.spans) as spans)).spans"
        ).alias("loss_spans"),
        "n_repeated",
        "n_new",
        F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + x["tok"]).alias("n_tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of the turns that a window is the first to show) and
    ``targets`` (unescaped texts under its loss mask), both read from ``formatted``."""
    pieces = F.expr("slice(split(formatted, '<[|]im_start[|]>', -1), n_repeated + 2, n_new)")

    def parsed(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        at = F.char_length(head) + 2
        return F.struct(
            unescape(head, role=True).alias("role"),
            unescape(F.substr(p, at, F.char_length(p) - at + 1 - len(END))).alias("text"),
        )

    return windows.withColumns(
        {
            "turns": F.transform(pieces, parsed),
            "targets": F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))),
        }
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation of ``format_conversations``' windows, read back from them."""
    part = F.struct("win", "turns", "targets", F.char_length("formatted").cast("long").alias("chars"))
    conv = read_windows(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("w"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    return conv.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )

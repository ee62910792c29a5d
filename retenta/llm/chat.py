"""Chat formatting: conversations as marked-up text with a loss mask, in DataFrame functions only.

The turns of a conversation are collected and sorted, adjacent turns of one role merge into
one message, and messages are joined:

    <|im_start|>ROLE \\n TEXT [<|im_sep|>TEXT ...] <|im_end|>\\n

Texts and roles may hold the control strings themselves. A backslash becomes two, and the
bar of ``<|`` gets one before it, so no control string survives inside a text and the
original can be read back exactly; a line break in a role becomes ``\\n`` spelt out.
The mask is a list of runs (characters, in the loss or not) that covers the formatted text.

Nulls and ties: a null text or role is an empty one; a null turn sorts first; rows of equal
turn are ordered by role and text, and repeated rows stay, one turn each; rows without a
conversation id are one conversation of null id. An empty table gives no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.llm.exprs import let

# The control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# End of fixed values.


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Doubled backslashes stand aside while the spelt-out line breaks are put back.
    parts = F.split(role, r"\\\\")
    return F.array_join(
        F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\"
    )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask`` (array of runs: chars, loss) of each conversation."""
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("text", "role"))
    row = F.struct("turn", role.alias("role"), text.alias("text"))
    sorted_turns = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("row")).alias("turns")
    )

    def merged(t: Column) -> Column:
        """One struct (role, texts) per run of turns of one role."""
        first = lambda x, i: (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
        starts = F.filter(
            F.transform(t, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull()
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(t, at)["role"].alias("role"),
                    F.transform(
                        F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: escape(x["text"])
                    ).alias("texts"),
                ),
            ),
        )

    def segments(m: Column) -> Column:
        """Head, texts, separators and end of a message, each with its part in the loss."""
        plain = lambda s: F.struct(s.alias("part"), F.lit(False).alias("loss"))
        head = F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
        body = F.transform(
            m["texts"],
            lambda x, i: F.array(
                plain(F.when(i == 0, head).otherwise(F.lit(SEP))),
                F.struct(x.alias("part"), (m["role"] == loss_role).alias("loss")),
            ),
        )
        return F.concat(F.flatten(body), F.array(plain(F.lit(END + "\n"))))

    parts = F.flatten(F.transform(merged(F.col("turns")), segments))
    return sorted_turns.select("conv_id", parts.alias("parts")).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.transform(
            "parts", lambda p: F.struct(F.char_length(p["part"]).cast("long").alias("chars"), p["loss"].alias("loss"))
        ).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before merging."""
    messages = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(message: Column) -> Column:
        head = F.substring_index(message, "\n", 1)
        body = F.substr(message, F.char_length(head) + 2, F.char_length(message) - F.char_length(head) - 1 - len(END + "\n"))
        texts = F.split(body, r"<\|im_sep\|>")
        return F.transform(texts, lambda x: F.struct(unescape_role(head).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The original texts under the mask, in order."""
    walk = F.aggregate(
        mask,
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("texts")),
        lambda a, run: F.struct(
            (a["at"] + run["chars"]).alias("at"),
            F.when(
                run["loss"], F.concat(a["texts"], F.array(F.substr(formatted, a["at"].cast("int"), run["chars"].cast("int"))))
            )
            .otherwise(a["texts"])
            .alias("texts"),
        ),
        lambda a: a["texts"],
    )
    return F.transform(walk, unescape)


def digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    read = conversations.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

A template names each role's opening and closing mark and whether its text counts for the loss. `<` only ever starts a
mark: inside texts and roles it is written `\\l`, and a backslash `\\b`, so texts that hold marks or escapes come back
exactly. A conversation becomes segments (text, loss), one string, and the loss spans as code-point offsets.

Edge cases: a null text or role is empty. Equal turn numbers are ordered by role, then text, and all are kept. A role
order the machine doesn't know makes `valid` false; the conversation is formatted all the same. Roles without an entry
use the template's default and carry no loss. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """open and close wrap a turn; {role} stands for the escaped role. Marks start with `<` and hold no other one."""

    open: str = "<turn {role}>\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("user", "assistant")


TEMPLATE = ChatTemplate()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    """A role stands inside a mark, so its `>` is written `\\g` as well."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def _role_mark(mark: str, role: Column) -> Column:
    before, found, after = mark.partition("{role}")
    return F.concat(F.lit(before), escape_role(role), F.lit(after)) if found else F.lit(mark)


def _final_state(turns: Column, template: ChatTemplate) -> Column:
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(turns, F.lit(template.start), lambda state, t: F.coalesce(F.try_element_at(table, F.concat_ws("\n", state, t["role"])), F.lit("error")))


def format_chats(df: DataFrame, template: ChatTemplate = TEMPLATE, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: key, valid, segments, formatted, loss_spans (start from 0, length; code points)."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = df.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def segments(turns: Column) -> Column:
        return F.flatten(
            F.transform(
                turns,
                lambda t: F.array(
                    F.struct(_role_mark(template.open, t["role"]).alias("text"), F.lit(False).alias("loss")),
                    F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                    F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
                ),
            )
        )

    def spans(parts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

        def step(acc: Column, s: Column) -> Column:
            size = F.length(s["text"]).cast("long")
            span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
            return F.struct((acc["at"] + size).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(parts, zero, step, lambda acc: acc["spans"])

    return (
        chats.select("key", _final_state(F.col("turns"), template).isin(*template.final).alias("valid"), segments(F.col("turns")).alias("segments"))
        .select("key", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans(F.col("segments")).alias("loss_spans"))
        .withColumnRenamed("key", key)
    )


def read_chats(df: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Parse `formatted` and `loss_spans` back: adds turns (role, text) and loss_texts, both unescaped."""
    before, _, after = template.open.partition("{role}")

    def turn(part: Column) -> Column:
        end = F.instr(part, after)
        return F.struct(
            unescape(F.substring(part, F.lit(1), end - 1)).alias("role"),
            unescape(part.substr(end + len(after), F.length(part))).alias("text"),
        )

    # after the opening of each turn come its role, the rest of the mark and the text up to the closing mark
    bodies = F.transform(
        F.filter(F.split(F.col("formatted"), "\\Q" + template.close + "\\E"), lambda p: p != ""),
        lambda p: F.substring(p, F.lit(len(before) + 1), F.length(p)),
    )
    formatted = F.col("formatted")
    return df.withColumn("turns", F.transform(bodies, turn)).withColumn(
        "loss_texts", F.transform("loss_spans", lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )


def digest_turns(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


__all__ = ["TEMPLATE", "ChatTemplate", "digest_turns", "escape", "format_chats", "read_chats", "unescape"]

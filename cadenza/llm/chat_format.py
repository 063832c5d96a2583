"""Chat formatting: conversations of role-tagged turns become one training text with a loss mask.

Template, where TEXT and NAME are escaped::

    <s>HEAD TEXT ([TURN]HEAD TEXT)* </s>      one message: adjacent turns of one role
    HEAD = [INST] for user, [/INST] for assistant, [ROLE]NAME[/ROLE] for any other role

(no blanks are added). Inside texts and role names a backslash is doubled, and a control string gets a
backslash after its first character, so none is left in them; :func:`unescaped` undoes both.

The turns of a conversation are sorted and merged in two steps, so that no task holds more of a long
conversation than a bounded run of turns until its one output row is made: runs of ``RUN`` turn
numbers are collected, sorted and folded with array aggregation, and then the folded runs are joined.
The loss mask is a list of byte spans in the UTF-8 form of the text, one for each assistant turn.

Defined cases: a null text or role counts as empty; turns of equal number are ordered by role, then
text; a null turn number comes first; rows with a null conv_id form one conversation of their own;
repeated rows are turns like any other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE, AGAIN = "<s>", "</s>", "[TURN]"
#: Turn numbers that are folded together before a conversation is joined.
RUN = 64
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|/?ROLE\]|TURN\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _head(role: Column) -> Column:
    return (
        F.when(role == "user", F.lit("[INST]"))
        .when(role == "assistant", F.lit("[/INST]"))
        .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]")))
    )


def _mark(before: Column, role: Column) -> Column:
    """What stands between a turn of role ``before`` (null: none) and one of ``role``."""
    opening = F.when(before.isNull(), F.lit(OPEN)).when(before == role, F.lit(AGAIN)).otherwise(F.lit(CLOSE + OPEN))
    return F.concat(opening, _head(role))


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _folded(turns: Column) -> Column:
    """A run of sorted turns as one piece of text, without the mark that stands before its first turn."""
    empty = F.struct(
        F.lit(None).cast("string").alias("role"),
        F.lit("").alias("text"),
        F.lit(0).cast("long").alias("bytes"),
        F.expr("cast(array() as array<struct<start: bigint, bytes: bigint>>)").alias("spans"),
    )

    def add(run: Column, turn: Column) -> Column:
        role, body = turn["role"], escaped(turn["text"])

        def joined(mark: Column) -> Column:
            start = run["bytes"] + _size(mark)
            span = F.struct(start.alias("start"), _size(body).alias("bytes"))
            return F.struct(
                role.alias("role"),
                F.concat(run["text"], mark, body).alias("text"),
                (start + _size(body)).alias("bytes"),
                F.when(role == "assistant", F.concat(run["spans"], F.array(span))).otherwise(run["spans"]).alias("spans"),
            )

        return joined(F.when(run["role"].isNull(), F.lit("")).otherwise(_mark(run["role"], role)))

    return F.aggregate(turns, empty, add)


def format_chats(turns: DataFrame, run: int = RUN) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and bytes), n_turns.

    ``turns`` has conv_id, turn, role and text.
    """
    clean = turns.select(
        "conv_id",
        F.floor(F.col("turn") / run).alias("run"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    runs = clean.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    folded = runs.select(
        "conv_id", F.struct("run", F.col("ts")[0]["role"].alias("first"), F.size("ts").alias("n"), _folded(F.col("ts")).alias("f")).alias("r")
    )
    whole = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))

    def marked(rs: Column) -> Column:
        return F.transform(
            rs,
            lambda r, i: F.struct(
                _mark(F.when(i > 0, F.get(rs, i - 1)["f"]["role"]), r["first"]).alias("mark"), r["f"].alias("f"), r["n"].alias("n")
            ),
        )

    def bases(ps: Column) -> Column:
        """Where each piece's text starts; one place more than pieces."""
        return F.aggregate(
            ps,
            F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("all")),
            lambda s, p: F.struct(
                (s["at"] + _size(p["mark"]) + p["f"]["bytes"]).alias("at"), F.concat(s["all"], F.array(s["at"] + _size(p["mark"]))).alias("all")
            ),
            lambda s: s["all"],
        )

    def spans(ps: Column) -> Column:
        return let(
            bases(ps),
            lambda at: F.flatten(
                F.transform(
                    ps,
                    lambda p, i: F.transform(
                        p["f"]["spans"], lambda s: F.struct((F.get(at, i) + s["start"]).alias("start"), s["bytes"].alias("bytes"))
                    ),
                )
            ),
        )

    pieces = whole.select("conv_id", let(F.col("rs"), marked).alias("ps"))
    text = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["mark"], p["f"]["text"])), ""), F.lit(CLOSE))
    return pieces.select(
        "conv_id",
        text.alias("formatted"),
        let(F.col("ps"), spans).alias("loss_spans"),
        F.aggregate("ps", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_turns"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, read from the text alone."""
    pieces = F.split(formatted, r"(?=<s>|\[TURN\])")

    def turn(piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"^(?:<s>|\[TURN\])|</s>$", "")
        head = F.substring_index(bare, "]", 1)
        other = F.regexp_extract(bare, r"^\[ROLE\]([\s\S]*?)\[/ROLE\]", 1)
        role = F.when(head == "[INST", F.lit("user")).when(head == "[/INST", F.lit("assistant")).otherwise(unescaped(other))
        text = F.regexp_replace(bare, r"^(?:\[/?INST\]|\[ROLE\][\s\S]*?\[/ROLE\])", "")
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""

    def cut(raw: Column) -> Column:
        part = F.transform(
            spans, lambda s: F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")
        )
        return F.array_join(F.transform(part, unescaped), "")

    return let(F.encode(formatted, "UTF-8"), cut)

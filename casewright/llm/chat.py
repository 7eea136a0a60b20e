"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

A conversation is one output string and one loss mask, so its rows meet in one aggregate row; that is the unit of the
result and the only gathering here. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, which roles count for the loss, and the transitions of the machine that checks the order of turns.

    ``escape`` goes before every ``marker[1]`` that follows ``marker[0]`` in a text, and before itself, so that no text
    holds a control string; every control string starts with ``marker``.
    """

    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    marker: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: Column, t: Template = CHATML) -> Column:
    twice = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(twice, F.lit(t.marker), F.lit(t.marker[0] + t.escape + t.marker[1:]))


def unescaped(text: Column, t: Template = CHATML) -> Column:
    return F.regexp_replace(text, "(?s)" + _quoted(t.escape) + "(.)", "$1")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHATML) -> DataFrame:
    """One row per conversation: id, n_turns, segments (array of text, loss), formatted, valid, first_bad.

    Turns are in the order of ``turn`` (null first), then role, then text. Null text and null role count as empty.
    ``formatted`` is all segments in a row. Only texts of the loss roles are under the loss, not their control strings.
    The machine does not drop conversations: ``valid`` is false if a turn has no move or the last state does not
    accept, and ``first_bad`` is the 1-based turn without a move. Rows with a null id form one conversation. Repeated
    rows are turns like others. Other columns are not read.
    """
    t = template
    turns = rows.groupBy(F.col(conv_col)).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))).alias("turns")
    )
    plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    role = lambda x: F.replace(escaped(x["role"], t), F.lit(t.role_end), F.lit(t.escape + t.role_end))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                plain(F.concat(F.lit(t.open), role(x), F.lit(t.role_end))),
                F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                plain(F.lit(t.close)),
            ),
        )
    )
    moves = F.create_map(*[F.lit(v) for (a, b), to in t.moves.items() for v in (f"{a}\x00{b}", to)])
    stuck = F.lit("\x00")  # no state is called so, and nothing leads out of it
    after = lambda acc, x: F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit("\x00"), x["role"])), stuck)
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            after(acc, x).alias("state"), (acc["at"] + 1).alias("at"), F.coalesce(acc["bad"], F.when(after(acc, x) == stuck, acc["at"] + 1)).alias("bad")
        ),
    )
    return (
        turns.select(conv_col, F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), walk.alias("walk"))
        .select(
            conv_col, "n_turns", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
            (F.col("walk.bad").isNull() & F.col("walk.state").isin(*t.accept)).alias("valid"), F.col("walk.bad").alias("first_bad"),
        )
    )


def parse_chats(formatted: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) read back from a formatted string."""
    t = template
    pieces = F.filter(F.split(formatted, _quoted(t.close)), lambda p: F.length(p) > 0)
    head = f"(?s)^{_quoted(t.open)}((?:[^{_quoted(t.escape)}\n]|{_quoted(t.escape)}.)*)\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1), t).alias("role"), unescaped(F.regexp_extract(p, head, 2), t).alias("text")),
    )

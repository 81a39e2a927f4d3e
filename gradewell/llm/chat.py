"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as its turns in order::

    <s>[INST]role[/INST]text</s>

The rendered string is parsed again by the grammar above and compared with the
source. Where that differs, the texts hold control strings, and they are escaped:
each ``<`` or ``[`` that begins a control string, with any backslashes after it,
gets one more backslash; the parser takes one away. Escaping is undone exactly,
so the second rendering reads back as the source, which is checked too.

The loss mask has a span for each assistant turn: the turn's number, and the
first character and the length of its text within the rendered turn. A digest of
a conversation needs all of it in one row, so a conversation is one row here; it
is the only thing that must fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1$2\\$3")
UNESCAPE = (r"([<\[])(\\*)\\(/?(?:s>|INST\]))", r"$1$2$3")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, *ESCAPE)


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, *UNESCAPE)


def render(turns: Column, spell) -> Column:
    """The string of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(BEGIN), spell(t["role"]), F.lit(MIDDLE), spell(t["text"]), F.lit(END))), "")


def rendered_turns(rendered: Column) -> Column:
    """The strings of the turns, without the end marks. What follows the last end
    mark is empty in a well-formed string, and is left out."""
    parts = F.split(rendered, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def head(turn: Column) -> Column:
    """A rendered turn up to the text."""
    return F.concat(F.substring_index(turn, MIDDLE, 1), F.lit(MIDDLE))


def parse(rendered: Column) -> Column:
    """The array of (role, text) that a rendered string stands for."""
    def one(turn):
        role = F.substring(F.substring_index(turn, MIDDLE, 1), len(BEGIN) + 1, 2 ** 31 - 1)
        text = F.substr(turn, F.length(head(turn)) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
    return F.transform(rendered_turns(rendered), one)


def loss_mask(rendered: Column, role: str) -> Column:
    spans = F.transform(rendered_turns(rendered), lambda t, i: F.struct(
        i.alias("turn"), F.length(head(t)).alias("start"), (F.length(t) - F.length(head(t))).alias("chars"),
        t.startswith(BEGIN + role + MIDDLE).alias("learned")))
    return F.transform(F.filter(spans, lambda s: s["learned"]),
                       lambda s: F.struct(s["turn"], s["start"], s["chars"]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_mask)``, one row for each conversation.

    Turns go by their number, equal numbers by role and then text (null numbers
    first); repeated rows are turns of their own. Null roles and texts are empty;
    rows without a conversation id form one conversation with a null id; an empty
    table gives an empty result; other columns are not read.
    """
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                          F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                          F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = source.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    plain = whole.withColumn("plain", render(F.col("turns"), lambda c: c))
    tried = plain.withColumn("formatted", F.when(parse(F.col("plain")) == F.col("turns"), F.col("plain"))
                             .otherwise(render(F.col("turns"), escaped)))
    safe = F.when(parse(F.col("formatted")) == F.col("turns"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not read back as it was")))
    return (tried.select("conv_id", safe.alias("formatted"))
            .withColumn("loss_mask", loss_mask(F.col("formatted"), learned)))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, learned)``: turns and the text under the loss mask, read
    from the formatted strings and the masks."""
    parts = rendered_turns(F.col("formatted"))
    return (formatted.withColumn("parts", parts)
            .select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                    F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substr(
                        F.get("parts", m["turn"]), m["start"] + 1, m["chars"]))), "").alias("learned")))

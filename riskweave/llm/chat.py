"""Chat formatting from event logs, with DataFrame functions alone.

A log row is an event of a message: `delta` appends its text, `edit` replaces the text by its own,
`regenerate` drops the text so that later deltas build it anew. Logs are dealt by conversation once;
in it each message folds its events after the last edit or regeneration, in order of sequence, and
messages in order form the conversation, which is rendered as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

per turn. Inside roles and texts `\\`, `<`, `[` and (in roles) line ends become `\\0`, `\\1`, `\\2`, `\\3`, so
no control string of any template that starts with `<` or `[` can stand there, and reading undoes
it exactly. The loss mask comes as flags of the segments of which the formatted text consists.

Cases: null texts and roles are empty; events of unknown kinds count as deltas; events of equal
sequence are taken in the order of kind and text; repeated rows are events of their own. A
conversation is one output row and so in one task; its memory follows the longest conversation. Very
long texts are taken whole; an empty log gives no conversation; columns besides those of a log are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: marks of turns, and what stands for characters inside texts.
START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\3")]
LEARNT_ROLE = "assistant"


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def messages(events: DataFrame) -> DataFrame:
    """events (conv_id, message, seq, kind, role, text) -> conv_id, message, role, text, in the partitioning of conv_id."""
    events = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role")))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e.kind.isin("edit", "regenerate"), i).otherwise(-1)))
    live = F.filter("log", lambda e, i: (i > F.col("last")) | ((i == F.col("last")) & (e.kind == "edit")))
    folded = events.repartition("conv_id").groupBy("conv_id", "message").agg(log.alias("log")).withColumn("last", last)
    return folded.select("conv_id", "message", F.element_at("log", -1).role.alias("role"), F.array_join(F.transform(live, lambda e: e.text), "").alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """messages (conv_id, message, role, text) -> conv_id, formatted, segments (array of text and loss); the segments' texts joined are the formatted text."""
    turns = F.sort_array(F.collect_list(F.struct("message", "role", "text")))
    segments = F.flatten(
        F.transform(
            turns,
            lambda m: F.array(
                F.struct(F.concat(F.lit(START), escaped(m.role, ROLE_ESCAPES), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(m.text).alias("text"), (m.role == LEARNT_ROLE).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = messages.groupBy("conv_id").agg(segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_back(out: DataFrame) -> DataFrame:
    """formatted's output -> conv_id, turns (array of role and text) parsed from the formatted text, loss_text (under the mask, unescaped), formatted."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    end = F.length(F.lit(END))
    turn = lambda p: F.struct(unescaped(F.substring_index(p, "\n", 1), ROLE_ESCAPES).alias("role"), unescaped(p.substr(F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - end)).alias("text"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(s.text)), "")
    return out.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"), "formatted")


def as_events(table: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: each row streams its text by two deltas after a draft that is regenerated. Rows of one turn stay messages of their own, in order of role and text."""
    rows = table.select("conv_id", F.struct(F.col("turn"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("copy")).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    steps = F.array(event(0, "delta", F.col("text").substr(F.lit(1), half)), event(1, "regenerate", F.lit("")), event(2, "delta", F.col("text").substr(F.lit(1), half)), event(3, "delta", F.col("text").substr(half + 1, F.length("text"))))
    return rows.select("conv_id", "message", "role", F.inline(steps))

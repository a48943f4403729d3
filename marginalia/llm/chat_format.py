"""Chat formatting: a grammar round trip, in DataFrame functions only.

A turn is rendered as ``[INST] user [/INST]``, ``<<SYS>>system<</SYS>>``,
``assistant</s>`` or, for any other role, ``<<ROLE:hex>>text<</ROLE>>``.  The
parser is one regular expression and always undoes escapes.  Each turn is
rendered raw, parsed, and compared with its source; a turn that comes back
different is escaped (a backslash goes into every control string, after any
that are there).  The whole conversation is then parsed and compared again,
escaped throughout if that differs, and raises an error should it differ still.

Null texts are empty texts and a null role an empty role.  Turns go by ``turn``
(nulls first), ties by role, then text; repeated rows are turns of their own.
Rows with a null conversation id are one conversation.  A conversation becomes
one string, so its turns meet in one task; they are rendered and checked before
that.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import bound, running_sum

_OPEN = r"([\[<])"
_REST = r"(/?INST\]|/s>|</?SYS>>|</ROLE>>|<ROLE:[0-9A-F]*>>)"
ESCAPE = (_OPEN + r"(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (_OPEN + r"\\(\\*)" + _REST, r"$1$2$3")
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|<<ROLE:[0-9A-F]*>>.*?<</ROLE>>|.*?</s>"


def render(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<ROLE:"), F.hex(role.cast("binary")), F.lit(">>"), text, F.lit("<</ROLE>>")))
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text, chars>>`` of a rendered string; chars: length of the turn as rendered."""

    def turn(s: Column) -> Column:
        inner = lambda before, after: s.substr(F.lit(before + 1), F.length(s) - before - after)
        user = s.startswith("[INST] ") & s.endswith(" [/INST]") & (F.length(s) >= 15)
        system = s.startswith("<<SYS>>") & s.endswith("<</SYS>>")
        other = s.startswith("<<ROLE:") & s.endswith("<</ROLE>>")
        role = F.when(user, "user").when(system, "system").when(other, F.decode(F.unhex(F.regexp_extract(s, r"^<<ROLE:([0-9A-F]*)>>", 1)), "UTF-8")).otherwise("assistant")
        text = F.when(user, inner(7, 8)).when(system, inner(7, 8)).when(other, F.regexp_extract(s, r"(?s)^<<ROLE:[0-9A-F]*>>(.*)<</ROLE>>$", 1)).otherwise(inner(0, 4))
        return F.struct(role.alias("role"), F.regexp_replace(text, *UNESCAPE).alias("text"), F.length(s).alias("chars"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def loss_mask(turns: Column) -> Column:
    """``array<struct<start, end>>``: the places in the formatted text that the loss counts, each assistant turn less its end mark."""

    own = lambda at: F.transform(turns, lambda t, k: F.when(t["role"] == "assistant", F.struct(F.get(at, k).alias("start"), (F.get(at, k) + t["chars"] - 4).alias("end"))))
    starts = running_sum(F.transform(turns, lambda t: t["chars"]))
    return bound(starts, lambda at: F.filter(own(at), lambda x: x.isNotNull()))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a loss mask, unescaped."""
    return F.transform(mask, lambda m: F.regexp_replace(formatted.substr(m["start"] + 1, m["end"] - m["start"]), *UNESCAPE))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversation id, ``formatted`` string, the ``turns`` read back from it, and the ``loss_mask`` over it."""
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = render(F.col("role"), F.col("text"))
    turns = turns.withColumn("raw", raw).withColumn("back", _plain(parse(F.col("raw"))))
    same = F.col("back") == F.array(F.struct("role", "text"))
    turns = turns.select("conv", "turn", "role", "text", F.when(same, F.col("raw")).otherwise(render(F.col("role"), escape(F.col("text")))).alias("shown"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("source"))
    whole = whole.withColumn("formatted", F.array_join("source.shown", "")).withColumn("turns", parse(F.col("formatted")))
    wanted = lambda: F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    safe = F.array_join(F.transform("source", lambda t: render(t["role"], escape(t["text"]))), "")
    whole = whole.withColumn("same", _plain(F.col("turns")) == wanted())
    whole = whole.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(safe))
    whole = whole.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted"))))
    checked = F.when(F.col("same") | (_plain(F.col("turns")) == wanted()), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return whole.select(F.col("conv").alias(conv_col), checked.alias("formatted"), "turns", loss_mask(F.col("turns")).alias("loss_mask"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back from the formatted text, and of what its loss mask covers."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_mask")), "")
    return formatted.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting: turns of a conversation as one marked-up text with a loss mask, and back, by Spark expressions only.

The template::

    <s>[INST] user text [/INST] assistant text </s><<SYS>>role
     text of any other role <</SYS>>

Adjacent turns of one role are one block, their texts parted by `` <+> ``. The control strings are
``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>`` and ``<+>``. Inside a text a backslash
follows their first character; where k backslashes stand there already, k + 1 do, so
escaping is reversed by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, running

JOINER = " <+> "
#: Characters into which a formatted text is cut when it is read back, so that this takes time with its length.
CUT = 256
_ANGLE, _SQUARE = r"(/?s>|\+>|<SYS>>|</SYS>>)", r"(/?INST\])"
_BLOCK = r"(?s)(\[INST\] .*? \[/INST\]|<<SYS>>.*? <</SYS>>| .*? </s>)"


def escape(text: Column) -> Column:
    """text with every control string broken by one backslash more."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)" + _ANGLE, r"<\\$1$2"), r"\[(\\*)" + _SQUARE, r"[\\$1$2")


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)" + _ANGLE, "<$1$2"), r"\[\\(\\*)" + _SQUARE, "[$1$2")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted (text) and loss (array of start and end, in code points, end exclusive) of each conversation.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are in order of
    turn, then role, then text; a null turn comes first; rows that repeat all stay. A null role or
    text is empty. Rows without conv_id are one conversation. Loss falls on each assistant text, without what marks it.
    A conversation becomes one value, so its turns meet in one task; only their own texts do.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"))))
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(sorted_turns.alias("turns"))
    own = F.col("turns")

    def piece(t: Column, i: Column) -> Column:
        # Whether the turns before and after are of the same role decides what marks stand around a text.
        first = (i == 0) | (F.get(own, i - 1)["role"] != t["role"])
        last = (i == F.size(own) - 1) | (F.get(own, i + 1)["role"] != t["role"])
        opens = F.when(t["role"] == "user", "[INST] ").when(t["role"] == "assistant", " ").otherwise(F.concat(F.lit("<<SYS>>"), F.url_encode(t["role"]), F.lit("\n ")))
        closes = F.when(t["role"] == "user", " [/INST]").when(t["role"] == "assistant", " </s>").otherwise(" <</SYS>>")
        return F.struct(
            F.when(first, opens).otherwise(F.lit(JOINER)).alias("before"),
            escape(t["text"]).alias("body"),
            F.when(last, closes).otherwise(F.lit("")).alias("after"),
            (t["role"] == "assistant").alias("loss"),
        )

    pieces = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.transform("turns", piece).alias("pieces"))
    size = lambda p: (F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).cast("long")
    span = lambda p, end: F.struct((3 + end - F.length(p["after"]) - F.length(p["body"])).alias("start"), (3 + end - F.length(p["after"])).alias("end"), p["loss"].alias("loss"))
    spans = F.zip_with("pieces", running(F.transform("pieces", size)), span)
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    joined = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), ""))
    return pieces.select("conv_id", "n_turns", joined.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text, as given to format_turns, in order) and loss_text read back from it."""

    def block(b: Column) -> Column:
        user, other = b.startswith("[INST] "), b.startswith("<<SYS>>")
        head = F.substring_index(b, "\n", 1)
        role = F.when(user, "user").when(other, F.url_decode(F.substring(head, 8, 1 << 30))).otherwise("assistant")
        start = F.when(user, 7).when(other, F.length(head) + 2).otherwise(1)
        end = F.when(user, 8).when(other, 9).otherwise(5)
        inner = F.substring(b, start + 1, F.length(b) - start - end)
        return F.transform(F.split(inner, r" <\+> "), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(F.regexp_extract_all("formatted", F.lit(_BLOCK), 1), block))
    masked = bound(F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUT}}}"), 0), lambda cuts: F.transform("loss", lambda s: unescape(_between(cuts, s["start"], s["end"]))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def _between(cuts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in cuts of CUT characters: only cuts that have some are read."""
    first = F.floor(start / CUT)
    count = F.greatest(F.lit(0), F.floor((end - 1) / CUT) - first + 1)
    held = F.array_join(F.slice(cuts, (first + 1).cast("int"), count.cast("int")), "")
    return F.substring(held, (start - first * CUT + 1).cast("int"), (end - start).cast("int"))

"""Text functions as column expressions: foldings, report wording, stamps and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import WHITE, WORD, bare, bare_letters, once, trimmed


def fold(text: Column) -> Column:
    """Accents off, in all scripts, then lower case; everything else stays, in canonical decomposition."""
    return F.lower(bare(text))


def canonical(name: Column) -> Column:
    """Accents off, lower case, and only a-z and 0-9: the key by which names are matched."""
    return F.regexp_replace(F.lower(bare_letters(name)), "[^a-z0-9]", "")


def plain_key(name: Column) -> Column:
    """Lower case and only a-z and 0-9, so that accented letters fall out: the key of providers' names."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def screen_fold(text: Column) -> Column:
    """fold() for text read off a screen: direction marks out, white space to single blanks, trimmed."""
    plain = F.regexp_replace(bare(text), "[\\u200e\\u200f\\u202a-\\u202e]", "")
    return F.lower(trimmed(F.regexp_replace(plain, f"[{WHITE}]+", " ")))


# The wordings of a report, folded.
ABSENT = "nao (?:achei|acharam|encontrei|encontraram|estava|estavam|encontrado)|ausente|nao encontrado|vazio|❌|❎"
PRESENT = "encontrei|encontrado|encontraram|estava|estavam|presente|acharam|achei|✅"
REVIEW = rf"[?]|(?<![{WORD}])(?:vou|vamos|sera|talvez|se aparecer|amanha|ontem|anteontem)(?![{WORD}])"
EMPTY, FOUND = "vazio", "encontrado"


def result_of(line: Column) -> Column:
    """What a line says: EMPTY before FOUND, null where it says neither."""
    return once(fold(line), lambda folded: F.when(folded.rlike(ABSENT), EMPTY).when(folded.rlike(PRESENT), FOUND))


def needs_review(text: Column) -> Column:
    """Whether a message asks, plans or speaks of another day, so that a person has to read it."""
    return fold(text).rlike(REVIEW)


# Fixed value: a stamp and sender before a line.
_STAMP = rf"\A\[?(\d{{1,2}}):(\d{{2}})(?:,?[{WHITE}]+(\d{{1,2}})/(\d{{1,2}})/(\d{{2,4}}))?\]?[{WHITE}]*(?:[^:]{{1,60}}:[{WHITE}]*)?"
# Fixed value: a stamp of a chat, with the half of the day or without.
_CHAT_STAMP = rf"(?i)\[(\d{{1,2}}):(\d{{2}})(?:[{WHITE}]*([AP]M))?,[{WHITE}]*(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{2,4}})\]"
# What goes from a page, and a whole number with dots between thousands.
_SCRIPT, _TAG = rf"(?i)<script(?![{WORD}])[^>]*>(?s:.*?)</script>", "<[^>]*>"
_NUMBER = r"([+−-]?[\d.]+)"


def line_stamp(line: Column) -> Column:
    """time and date (text; null where absent) of a stamp at a line's beginning, and the rest of the line."""
    part = lambda i: F.regexp_extract(line, _STAMP, i)
    year = F.when(F.length(part(5)) == 2, F.concat(F.lit("20"), part(5))).otherwise(part(5))
    time = F.when(part(1) != "", F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), part(2)))
    date = F.when(part(3) != "", F.concat_ws("-", year, F.lpad(part(4), 2, "0"), F.lpad(part(3), 2, "0")))
    return F.struct(time.alias("time"), date.alias("date"), F.regexp_replace(line, _STAMP, "").alias("rest"))


def chat_stamp(meta: Column) -> Column:
    """time and date of a chat stamp like [9:12 PM, 05/10/26], with / . or - between; both null unless there is such a day and time."""
    part = lambda i: F.regexp_extract(meta, _CHAT_STAMP, i)
    hour = part(1).try_cast("int")
    half = F.upper(part(3))
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    year = F.when(F.length(part(6)) == 2, F.concat(F.lit("20"), part(6))).otherwise(part(6))
    date = F.concat_ws("-", year, F.lpad(part(5), 2, "0"), F.lpad(part(4), 2, "0"))
    good = (F.length(year) == 4) & F.try_to_date(date, "yyyy-MM-dd").isNotNull() & (hour < 24) & (part(2).try_cast("int") < 60)
    time = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2))
    return F.struct(F.when(good, time).alias("time"), F.when(good, date).alias("date"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts out, tags to blanks, white space to single blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _SCRIPT, ""), _TAG, " "), f"[{WHITE}]+", " ")


def labelled_number(text: Column, label: str) -> Column:
    """The whole number after a label and white space, with dots between thousands and any minus sign; null if absent or over 2^53 - 1. Dots alone are 0."""
    found = F.regexp_extract(text, f"{label}[{WHITE}]+{_NUMBER}", 1)
    digits = F.translate(found, "−.", "-")
    value = F.when((found != "") & (digits == ""), F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))
    return F.when(F.abs(value) <= (1 << 53) - 1, value)

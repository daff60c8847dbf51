"""Column functions of the warehouse: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters after which a word of a proper name begins; fixed values.
WORD_BREAKS = r"""(?<=[\s!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>])"""
MISSING = "∅"


def initcap_words(c: Column) -> Column:
    """Capital at the start of each word, where words also end at punctuation: ``mogi-guacu`` gives ``Mogi-Guacu``."""
    words = F.split(F.lower(c), WORD_BREAKS)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def date_key(c: Column) -> Column:
    """A date as the integer yyyymmdd."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def days_between(start: Column, end: Column) -> Column:
    """Midnights passed from start to end; null where either is."""
    return F.datediff(end.cast("date"), start.cast("date"))


def money(c: Column, precision: int = 12) -> Column:
    """Rounded half up to two places, as a decimal."""
    return F.round(c.cast(f"decimal({precision + 6},6)"), 2).cast(f"decimal({precision},2)")


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries passed from start to end; null where either is."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def row_hash(*cols: Column) -> Column:
    """SHA-256 of the columns as text; nulls have a mark of their own, and cells cannot run into each other."""
    def escaped(c: Column) -> Column:
        c = c.cast("string")
        for mark in ("\\", "|", MISSING):
            c = F.replace(c, F.lit(mark), F.lit(f"\\{mark}"))
        return c

    return F.sha2(F.concat_ws("|", *[F.coalesce(escaped(c), F.lit(MISSING)) for c in cols]), 256)


def pass_rate(total: Column, failed: Column) -> Column:
    """100 (total - failed) / total to three places; null for an empty table."""
    return F.round(F.try_divide((total - failed) * F.lit(100), total), 3).cast("decimal(6,3)")


def differs(a: Column, b: Column) -> Column:
    """Whether a tracked text changed; null and the empty text are the same."""
    return F.coalesce(a.cast("string"), F.lit("")) != F.coalesce(b.cast("string"), F.lit(""))

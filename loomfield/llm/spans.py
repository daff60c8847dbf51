"""Regular-expression matches with their places, as DataFrame expressions only.

``split`` gives the texts between the leftmost non-overlapping matches and ``regexp_extract_all``
the matches; running sums of their lengths give each match's code-point range. Patterns are written
so that a failed start costs constant time, with possessive repeats that never recurse. A text's spans
are one array, which grows by copies: time goes with the square of the matches in a single text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<k: int, s: bigint, e: bigint, t: string>"


def found(text: Column, pattern: str, k: int) -> Column:
    """All matches of ``pattern`` as an array of (kind's place k, start, end exclusive, matched text)."""
    none = F.array().cast(f"array<{SPAN}>")
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["m"])
        span = F.struct(F.lit(k).alias("k"), s.alias("s"), e.alias("e"), x["m"].alias("t"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).cast(f"array<{SPAN}>").alias("out"))

    zipped = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    # The look for a first match spares most texts the other two passes.
    return F.when(text.rlike(pattern), F.aggregate(zipped, start.cast(f"struct<at: bigint, out: array<{SPAN}>>"), step)["out"]).otherwise(none)


def joined(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """``kind:start:end`` of the spans joined by commas; by start and then kind, or by kind and then start."""
    name = F.array(*[F.lit(x) for x in kinds])
    order = (lambda x: F.struct(x["s"], x["k"], x["e"])) if by_start else (lambda x: F.struct(x["k"], x["s"], x["e"]))
    keyed = F.array_sort(F.transform(spans, order))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")

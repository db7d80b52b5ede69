"""Matches of patterns with their places, and rewriting by spans, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
_STEP = 64


def place(pieces: Column, matches: Column) -> Column:
    """Where matches lie: ``pieces`` are the texts between them (``split``), ``matches`` the texts themselves.

    Offsets are code points, ends exclusive. Sums run over blocks of 64 matches and then within each, so a text of
    very many matches doesn't copy its whole list for each one.
    """
    each = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _STEP).cast("int")), lambda b: F.slice(each, b * _STEP + 1, _STEP))
    length = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["match"]))
    bases = F.aggregate(blocks, F.array(F.lit(0)), lambda have, block: F.concat(have, F.array(F.element_at(have, -1) + length(block))))

    def spans(pair: Column) -> Column:
        def add(have: Column, x: Column) -> Column:
            start = have["at"] + x["gap"]
            end = start + F.length(x["match"])
            return F.struct(end.alias("at"), F.concat(have["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

        zero = F.struct(pair["base"].alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(pair["block"], zero, add, lambda have: have["out"])

    pairs = F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda block, base: F.struct(block.alias("block"), base.alias("base")))
    return F.when(F.size(matches) > 0, F.flatten(F.transform(pairs, spans))).otherwise(F.array().cast(SPAN))


def find(text: Column, pattern: str, may: Column | None = None) -> tuple[Column, Column]:
    """Pieces and matches for ``place``; ``may`` is a cheap test that fails for texts without any match."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if may is None:
        return pieces, matches
    none = F.array().cast("array<string>")
    return F.when(may, pieces).otherwise(none), F.when(may, matches).otherwise(none)

"""Range algebra as Column expressions: positions are (line, character), ranges are half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One line weighs as many characters in a range's size.
LINE_WEIGHT = 10_000
LAST_CHARACTER = 4_294_967_295


def point(line: Column, character: Column) -> Column:
    """A position as one ordered long."""
    return F.shiftleft(line.cast("bigint"), 32).bitwiseOR(character.cast("bigint"))


def contains_position(start: Column, end: Column, at: Column) -> Column:
    return (at >= start) & (at < end)


def contains_range(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Both ends inclusive."""
    return (start >= outer_start) & (end <= outer_end)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Ranges that only touch do not overlap."""
    return (a_end > b_start) & (b_end > a_start)


def size(sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return (el - sl).cast("bigint") * LINE_WEIGHT + F.when(el == sl, ec - sc).otherwise(ec)


def expanded(sl: Column, el: Column, lines: int) -> tuple[Column, Column, Column, Column]:
    """The range and `lines` whole lines around it."""
    return F.greatest(sl - lines, F.lit(0)), F.lit(0), el + lines, F.lit(LAST_CHARACTER)

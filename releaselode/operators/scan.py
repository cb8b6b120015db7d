"""Running values over the lines of a text, for texts of any length.

A text's lines are dealt in blocks of neighbouring places. Each block is scanned by itself and leaves one row: what its last
line and its counts hand on. These rows, one a block, are scanned text by text, and what reaches each block from those
before it (and the first line of the one after it) is joined back. So no task ever holds a text, and the lines are shuffled once
for any number of such steps, since windows, block rows and joins all go by text and block.

Keys may hold nulls: they are packed in a struct, which is never null and equals another one with the same nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 4096

TEXT, PART, AT = "_text", "_block", "_at"


def within() -> WindowSpec:
    """A block, in order."""
    return Window.partitionBy(TEXT, PART).orderBy(AT)


def so_far() -> WindowSpec:
    return within().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def over() -> WindowSpec:
    """The rows of a text's blocks, in order."""
    return Window.partitionBy(TEXT).orderBy(PART)


def earlier() -> WindowSpec:
    return over().rowsBetween(Window.unboundedPreceding, -1)


def dealt(rows: DataFrame, key: list[str], place: str, size: int = BLOCK) -> DataFrame:
    """rows with their text, block and place."""
    return again(rows.withColumn(TEXT, F.struct(*key)), place, size)


def again(rows: DataFrame, place: str, size: int = BLOCK) -> DataFrame:
    """rows that have their text, dealt by another place."""
    return rows.withColumns({PART: F.floor(F.col(place) / size), AT: F.col(place)})


def first(value: Column) -> Column:
    return F.min_by(F.struct(value.alias("v")), AT)["v"]


def last(value: Column) -> Column:
    return F.max_by(F.struct(value.alias("v")), AT)["v"]


def told(rows: DataFrame, leave: dict[str, Column], steps: list[dict[str, Column]], take: list[str]) -> DataFrame:
    """rows, each with the columns `take` of its block.

    leave: aggregates of a block. steps: columns over the blocks' rows, each step upon those before it."""
    blocks = rows.groupBy(TEXT, PART).agg(*(c.alias(n) for n, c in leave.items()))
    for step in steps:
        blocks = blocks.withColumns(step)
    return rows.join(blocks.select(TEXT, PART, *take), [TEXT, PART])


def before(value: str) -> Column:
    """The sum over earlier blocks."""
    return F.coalesce(F.sum(value).over(earlier()), F.lit(0))


def unpacked(key: list[str]) -> list[Column]:
    return [F.col(TEXT)[k].alias(k) for k in key]

"""Sizes and positions as column expressions: images, tables, headings and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the layout: heading scale by level, points of body text, width of text, table gutter, limits.
HEADING_SCALE = (1.9, 1.55, 1.3, 1.15, 1.0, 0.92)
BODY_POINTS = 16.0
GUTTER = 24.0
LEAST_MEASURE = 120.0
IMAGE_HEIGHT = 420.0
GRID_WIDTH = 12000.0
SCALES = (1.0, 0.94, 0.88)
EMU_PER_PIXEL = 9525
EMU_WIDTH = 5943600
PAGE_TWIPS = 9360
ASSEMBLY_SHARE = 0.05
LEAST_GAP = 6.0


def heading_points(level: Column) -> Column:
    scale = F.array(*map(F.lit, HEADING_SCALE))
    return F.lit(BODY_POINTS) * F.element_at(scale, F.greatest(F.lit(1), F.least(F.lit(6), level)).cast("int"))


def image_scale(width: Column, height: Column, available: Column) -> Column:
    """An image is fitted to the width (80 at least), then to the height limit, and never enlarged."""
    by_width = F.least(F.lit(1.0), F.greatest(available, F.lit(80.0)) / width)
    return F.least(by_width, F.lit(IMAGE_HEIGHT) / height)


def emu_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height in EMU, at most a page wide, at least one, in proportion."""
    wide = width * EMU_PER_PIXEL
    scale = F.least(F.lit(1.0), F.lit(EMU_WIDTH) / wide)
    return tuple(F.greatest(F.lit(1), F.round(x * EMU_PER_PIXEL * scale)).cast("long") for x in (width, height))


def column_twips(columns: Column) -> Column:
    return F.floor(F.lit(PAGE_TWIPS) / F.greatest(columns, F.lit(1))).cast("long")


def outline_indent(level: Column) -> Column:
    return F.when(level <= 1, 10.0).otherwise(22.0 + 12.0 * (level - 2))


def clamped_progress(unit: Column, total: Column, fraction: Column) -> tuple[Column, Column, Column]:
    return F.greatest(unit, F.lit(1)), F.greatest(total, F.lit(1)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))


def unit_fraction(unit: Column, total: Column) -> Column:
    """Progress as a unit begins; the last part is kept for assembly."""
    return (1 - ASSEMBLY_SHARE) * (unit - 1) / total


def progress_text(phase: Column, unit: Column, total: Column) -> Column:
    return F.when(total > 1, F.concat(phase, F.lit(" page "), unit.cast("string"), F.lit(" of "), total.cast("string"))).otherwise(phase)


def grid_scale(natural: Column, available: Column) -> Column:
    """The first scale at which a table fits; full size, to be scrolled, if none does."""
    out = F.lit(SCALES[0])
    for s in reversed(SCALES):
        out = F.when(natural * s <= available, s).otherwise(out)
    return out


def stretched(width: Column, natural: Column, stretch: Column) -> Column:
    """A column's width when its table, natural wide in all, fills a wider text column in proportion."""
    return F.when((natural > 0) & (stretch > natural), width * stretch / natural).otherwise(width)


def delimiter_gap(target: Column, pen: Column) -> Column:
    """The width of a delimiter that reaches its column's boundary from where the pen stands; none without a boundary."""
    return F.when(target.isNull(), 0.0).otherwise(F.greatest(target - pen, F.lit(LEAST_GAP)))


def fitted(width: Column, height: Column, available: Column) -> tuple[Column, Column]:
    """A picture scaled down to a width, never up."""
    wider = (width > available) & (width > 0)
    return F.when(wider, available).otherwise(width), F.when(wider, height * available / width).otherwise(height)


def text_width(frame: Column, measure: Column, widest: Column) -> tuple[Column, Column]:
    """The column for text (between the least measure and the wanted one) and whether tables overflow it."""
    available = F.greatest(F.lit(LEAST_MEASURE), frame - 2 * GUTTER)
    return F.least(measure, available), widest > available + 1

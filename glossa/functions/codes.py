"""Positions, packed decimals, private-use character codes and glyph addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 2048
#: Bytes and columns of a glyph by height.
GLYPH_BYTES = {"narrow": {16: 16, 24: 48, 30: 60, 48: 144}, "wide": {16: 32, 24: 72, 30: 120, 48: 288}}
GLYPH_WIDTHS = {"narrow": {16: 8, 24: 16, 30: 16, 48: 24}, "wide": {16: 16, 24: 24, 30: 32, 48: 48}}


def location(page: Column, offset: Column) -> Column:
    return (page.cast("long") - 1) * PAGE + offset


def position(loc: Column) -> Column:
    return F.struct((F.floor(loc / PAGE) + 1).cast("long").alias("page"), (loc % PAGE).cast("int").alias("offset"))


def bcd(data: Column) -> Column:
    """Packed decimal: the hexadecimal digits are the decimal ones; null if any isn't decimal."""
    return F.hex(data).try_cast("long")


def be_uint(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")


def gaiji_name(narrow: Column, code: Column) -> Column:
    return F.concat(F.when(narrow, "h").otherwise("z"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def cell_after(start: Column, n: Column) -> Column:
    """The n-th code after start where a row's cells run from 0x21 to 0x7E."""
    index = (start % 256 - 0x21) + n
    return ((F.floor(start / 256) + F.floor(index / 94)) * 256 + 0x21 + index % 94).cast("long")


def font_last(start: Column, count: Column, latin: Column) -> Column:
    """The last code of a font whose rows have 94 cells up to 0x7E, or 254 up to 0xFE in Latin books."""
    per = F.when(latin, 0xFE).otherwise(0x5E)
    end = start + F.floor(count / per) * 256 + count % per - 1
    low = end % 256
    return F.when(latin & (low > 0xFE), end + 3).when(~latin & (low > 0x7E), end + 0xA3).otherwise(end).cast("long")


def glyph_address(index: Column, size: Column) -> Column:
    """Byte address of a glyph: chunks of 1024 bytes, and no glyph crosses one."""
    per = F.floor(F.lit(1024) / size)
    return (F.floor(index / per) * 1024 + index % per * size).cast("long")


def pbm(data: Column, width: Column, height: Column) -> Column:
    """A bitmap as the bytes of a binary PBM file."""
    return F.concat(F.encode(F.concat(F.lit("P4\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n")), "US-ASCII"), data)


def raster(data: Column, width: Column) -> Column:
    """A bitmap as rows of · and █: each byte's bits, cut into rows of whole bytes."""
    bits = F.translate(
        F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), ""), "01", "·█"
    )
    whole = (F.floor((width + 7) / 8) * 8).cast("int")
    line = lambda b, r: F.substring(b, (r * whole + 1).cast("int"), width.cast("int"))
    rows = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), (F.length(b) / whole).cast("int") - 1), lambda r: line(b, r)), "\n")
    # In an array, so that the bits are made once for all rows of the bitmap.
    return F.element_at(F.transform(F.array(bits), rows), 1)

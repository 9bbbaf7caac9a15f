"""Column helpers on BINARY, kept on the JVM side. Byte values are SMALLINT 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a string."""
    return _c(text).cast("binary")


def chars(data: Column | str) -> Column:
    """A binary as an array of one-character strings, one for each byte (Latin-1)."""
    return F.when(F.length(_c(data)) > 0, F.split(F.decode(_c(data), "ISO-8859-1"), "")).otherwise(F.array().cast("array<string>"))


def byte_of(char: Column) -> Column:
    """Byte value of one of chars()."""
    return F.ascii(char).cast("smallint")


def byte_at(data: Column | str, position: Column | int) -> Column:
    """Byte value at a 1-based position; null outside."""
    one = F.substr(_c(data), F.lit(position) if isinstance(position, int) else position, F.lit(1))
    return F.when(F.length(one) > 0, F.conv(F.hex(one), 16, 10).cast("smallint"))


def prefix(data: Column | str, n: Column) -> Column:
    """First n bytes."""
    return F.substr(_c(data), F.lit(1), n)


def suffix(data: Column | str, n: Column) -> Column:
    """Last n bytes, as BINARY (right() would give a string)."""
    return F.substr(_c(data), F.length(_c(data)) - n + 1, n)


def u32(data: Column | str, position: Column) -> Column:
    """Big-endian unsigned 32-bit number at a 1-based position, as BIGINT; null if cut short."""
    four = F.substr(_c(data), position, F.lit(4))
    return F.when(F.length(four) == 4, F.conv(F.hex(four), 16, 10).cast("bigint"))


def hex_byte(v: Column | str) -> Column:
    """Two lower-case hex digits."""
    return F.lower(F.lpad(F.hex(_c(v).cast("bigint")), 2, "0"))


def format_byte(v: Column | str) -> Column:
    """0xFF."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(_c(v).cast("bigint")), 2, "0"))


def format_offset(v: Column | str, width: int = 4) -> Column:
    """0x002A; pads to the width and never truncates."""
    h = F.hex(_c(v).cast("bigint"))
    return F.concat(F.lit("0x"), F.when(F.length(h) >= width, h).otherwise(F.lpad(h, width, "0")))


def preview(data: Column | str, n: int = 16) -> Column:
    """The first n bytes in lower-case hex, <empty> without any."""
    d = _c(data)
    return F.when(F.length(d) == 0, "<empty>").otherwise(F.lower(F.hex(F.substring(d, 1, n))))


def mismatches(left: Column, right: Column) -> Column:
    """Array of struct(overlap_offset, left_byte, right_byte), ascending, of two binaries of one length."""
    r = chars(right)
    pairs = F.transform(chars(left), lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("x"), F.get(r, i).alias("y")))
    return F.transform(F.filter(pairs, lambda p: p["x"] != p["y"]), lambda p: F.struct(p["i"].alias("overlap_offset"), byte_of(p["x"]).alias("left_byte"), byte_of(p["y"]).alias("right_byte")))


def similarity(matches: Column | str, overlap: Column | str) -> Column:
    """Per cent of matching bytes to two places; 0 for an empty overlap."""
    return F.when(_c(overlap) == 0, 0.0).otherwise(F.round(100.0 * _c(matches) / _c(overlap), 2))


def rate(numerator: Column | str, denominator: Column | str) -> Column:
    """A share, or null over nothing."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def splice(data: Column | str, position: Column, value: Column) -> Column:
    """Data with the byte at a 0-based position replaced."""
    d = _c(data)
    h = F.concat(F.hex(F.substr(d, F.lit(1), position)), F.lpad(F.hex(value.cast("bigint")), 2, "0"), F.hex(F.substr(d, position + 2, F.length(d))))
    return F.unhex(h)

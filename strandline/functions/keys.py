"""Checksum keys as compact, exactly comparable bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum_text(c: Column) -> Column:
    """A checksum without what carries no meaning: letter case, and blanks (U+0020) around it."""
    return F.lower(F.trim(c))


def checksum_key(c: Column) -> Column:
    """Bytes that are equal exactly where two checksums are equal.

    Well-formed hexadecimal is packed to half its length behind a zero byte, everything else (broken
    checksums) stays as text behind a one byte, so the two kinds cannot meet. Null gives null.
    """
    bare = F.trim(c)
    packed = F.concat(F.lit(b"\x00"), F.unhex(F.when(F.length(bare) % 2 == 0, bare)))
    return F.coalesce(packed, F.concat(F.lit(b"\x01"), F.encode(checksum_text(c), "utf-8")))


def checksum_of_key(c: Column) -> Column:
    """The normalised checksum that ``checksum_key`` packed."""
    tail = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(tail))).otherwise(F.decode(tail, "utf-8"))

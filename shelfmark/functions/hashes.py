"""Fingerprint columns: validation, 64-bit keys, Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(col: Column) -> Column:
    """Without surrounding white space of any kind (TRIM alone keeps tabs)."""
    return F.regexp_replace(col, r"^[\s ]+|[\s ]+$", "")


def valid_hex(col: Column, digits: int) -> Column:
    """The trimmed lower-case text if it has exactly ``digits`` hex digits, else null."""
    text = F.lower(F.trim(col))
    return F.when(text.rlike(f"^[0-9a-f]{{{digits}}}$"), text)


def hex_to_long(text: Column) -> Column:
    """16 hex digits as a signed 64-bit key; the bit pattern is kept."""
    high = F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def long_to_hex(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

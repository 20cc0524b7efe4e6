"""Identifiers that sort by time and depend on their row only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uuid7(at: Column, *facts: Column) -> Column:
    """A version 7 UUID: the milliseconds of an instant in microseconds, then bits of a hash of the row's facts in place of random ones, so that a task that runs again gives the same ids. Null where the instant is; null facts count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # each fact with its length before it: (1, 23) is not (12, 3)
    noise = F.sha2(F.concat(*(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)) for c in (at, *facts))), 256)
    ms = F.lower(F.lpad(F.hex(F.floor(at / 1000)), 12, "0"))
    variant = F.lower(F.hex(F.conv(F.substring(noise, 4, 1), 16, 10).cast("int") % 4 + 8))
    part = lambda first, n: F.substring(noise, first, n)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), part(1, 3), F.lit("-"), variant, part(5, 3), F.lit("-"), part(8, 12))

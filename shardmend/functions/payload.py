"""Column expressions over BINARY payloads; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(b: Column, percent: float) -> Column:
    """``percent`` of the length of ``b``, in whole bytes, cut toward zero."""
    return (F.length(b) * F.lit(float(percent)) / F.lit(100.0)).cast("int")


def head(b: Column, n: Column | int) -> Column:
    return F.substring(b, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def tail(b: Column, start: Column) -> Column:
    """What follows the first ``start`` bytes."""
    return F.substring(b, start + 1, F.greatest(F.length(b) - start, F.lit(0)))


def region(b: Column, start: float, end: float) -> tuple[Column, Column]:
    """Byte range between two percentages of the payload; swapped ends are put in order."""
    low, high = sorted((float(start), float(end)))
    return share(b, low), share(b, high)


def latin(b: Column) -> Column:
    """One character for each byte, so that string functions act on bytes."""
    return F.decode(b, "ISO-8859-1")


def unlatin(s: Column) -> Column:
    return F.encode(s, "ISO-8859-1")


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))

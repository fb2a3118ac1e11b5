"""Byte-level steps as Catalyst expressions: ``step(bytes, **params) -> bytes``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardmend.functions.payload import head, latin, region, share, tail, unlatin, zeros


def truncate(b: Column, percent: float = 60, byte: int = -1) -> Column:
    """Keep the first ``percent`` of the payload, or exactly ``byte`` bytes."""
    return head(b, share(b, percent) if byte < 0 else F.lit(int(byte)))


def interrupted_download(b: Column, percent: float = 70) -> Column:
    """A transfer that stopped at ``percent`` of the payload."""
    return truncate(b, percent)


def ftp_ascii(b: Column, direction: str = "lf_to_crlf") -> Column:
    """Line ends as a text-mode transfer rewrites them; an LF that follows a CR stays."""
    text = latin(b)
    if direction == "crlf_to_lf":
        return unlatin(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    return unlatin(F.regexp_replace(text, r"(?<!\r)\n", "\r\n"))


def byte_swap16(b: Column, start: float = 50, end: float = 100) -> Column:
    """Swap the bytes of each 16-bit word of a region; an odd last byte stays."""
    low, high = region(b, start, end)
    middle = F.regexp_replace(F.hex(F.substring(b, low + 1, high - low)), "(..)(..)", "$2$1")
    return F.concat(head(b, low), F.unhex(middle), tail(b, high))


def seven_bit(b: Column, start: float = 30) -> Column:
    """Clear the top bit of every byte from ``start`` percent to the end."""
    low = share(b, start)
    # Upper Latin-1 characters, in order, become their lower halves; translate() cannot write a NUL, so 0x80 goes apart.
    upper, lower = "".join(map(chr, range(129, 256))), "".join(map(chr, range(1, 128)))
    cleared = F.regexp_replace(F.translate(latin(tail(b, low)), upper, lower), "\u0080", "\u0000")
    return F.concat(head(b, low), unlatin(cleared))


def zero_fill(b: Column, at: float = 50, length: int = 4096) -> Column:
    """Overwrite ``length`` bytes from ``at`` percent with zeros, clipped to the end."""
    low = share(b, at)
    n = F.least(F.lit(int(length)), F.length(b) - low)
    return F.concat(head(b, low), zeros(n), tail(b, low + n))


def byte_patch(b: Column, at: int = 0, hexed: str = "") -> Column:
    """Overwrite bytes from offset ``at`` with those of ``hexed``, clipped to the end."""
    size = len(hexed) // 2
    n = F.greatest(F.least(F.lit(size), F.length(b) - F.lit(int(at))), F.lit(0))
    return F.concat(head(b, int(at)), head(F.unhex(F.lit(hexed)), n), tail(b, F.least(F.lit(int(at)) + n, F.length(b))))


STEPS = {f.__name__: f for f in (truncate, interrupted_download, ftp_ascii, byte_swap16, seven_bit, zero_fill, byte_patch)}

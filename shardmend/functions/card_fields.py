"""Fields of card file systems as column expressions: default clusters, labels, short names, packed times; sheet layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default cluster sizes in KB by file system, as (largest card in MB, KB); the last holds for all larger cards.
CLUSTER_KB = {
    "fat16": [(64, 2), (256, 4), (512, 8), (1024, 16), (None, 32)],
    "fat32": [(4096, 4), (None, 32)],
    "exfat": [(32768, 32), (None, 128)],
}
# Cells of a contact sheet by style: pictures in a row, cell, gap and head height in pixels; label height.
SHEETS = {"graft": (8, 160, 6, 0), "kodak": (6, 120, 10, 40)}


def default_cluster_kb(fs: Column, size_mb: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, steps in CLUSTER_KB.items():
        size = F.lit(steps[-1][1])
        for most, kb in reversed(steps[:-1]):
            size = F.when(size_mb <= most, F.lit(kb)).otherwise(size)
        out = F.when(fs == name, size).otherwise(out)
    return out


def volume_label(text: Column) -> Column:
    """Upper case, printable ASCII without what a label cannot hold, eleven characters at most."""
    plain = F.regexp_replace(text, r"""[^\x20-\x7E]|["*+,./:;<=>?\[\\\]|]""", "")
    return F.rtrim(F.substring(F.upper(plain), 1, 11))


def short_name(name: Column) -> Column:
    """Base and extension at their last dot, padded to eight and three, in upper case."""
    dotted = F.instr(name, ".") > 0
    base = F.when(dotted, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
    extension = F.when(dotted, F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(F.lit(""))
    return F.concat(F.rpad(F.upper(base), 8, " "), F.rpad(F.upper(extension), 3, " "))


def packed_time(stamp: Column) -> Column:
    """Date and time of seconds since 2000 in 32 bits; years of 365 days and months of 31, as cameras here count."""
    days, seconds = F.floor(stamp / 86400), stamp % 86400
    year, of_year = F.floor(days / 365) + 20, days % 365
    month, day = F.least(F.floor(of_year / 31) + 1, F.lit(12)), F.least(of_year % 31 + 1, F.lit(28))
    date = year * 512 + month * 32 + day
    time = F.floor(seconds / 3600) * 2048 + F.floor(seconds / 60) % 60 * 32 + F.floor(seconds % 60 / 2)
    return (date * 65536 + time).cast("long")


def sheet_cell(n: Column, x: Column, y: Column, style: str = "graft", label: int = 18) -> Column:
    """The number of the picture under a pixel of a contact sheet of ``n``, or -1."""
    row_of, cell, gap, top = SHEETS[style]
    column, row = F.floor((x - gap) / (cell + gap)), F.floor((y - top - gap) / (cell + label + gap))
    i = row * row_of + column
    return F.when((column >= 0) & (column < row_of) & (row >= 0) & (i < n), i).otherwise(F.lit(-1)).cast("long")

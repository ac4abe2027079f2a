"""Key and instant normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u000b\u000c 　"


def stripped(c: Column | str) -> Column:
    return F.btrim(c if isinstance(c, Column) else F.col(c), F.lit(BLANKS))


def folded(c: Column | str) -> Column:
    """Trimmed and lower-cased; blank texts become null."""
    s = F.lower(stripped(c))
    return F.when(s != "", s)


def text_instant(c: Column | str) -> Column:
    """UTC text in either spelling (``2024-01-05 10:00:00``, ``2024-01-05T10:00:00Z``) as TIMESTAMP_NTZ, else null.

    Independent of the session's time zone.
    """
    c = c if isinstance(c, Column) else F.col(c)
    return F.regexp_replace(stripped(c), "[Zz]$", "").try_cast("timestamp_ntz")

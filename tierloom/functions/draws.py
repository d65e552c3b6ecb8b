"""Random draws that any system can repeat: leading hex digits of the md5 of seed, name and keys.

A draw depends on its keys only, so results do not depend on partitions or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def hashed(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by bars, as 32 hex digits; plain values are taken as they are."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def fraction(digest: Column, first: int = 1, digits: int = DIGITS) -> Column:
    """Number in [0, 1) from hex digits of a hash."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long") / F.lit(float(16 ** digits))


def bucket(digest: Column) -> Column:
    """Leading 12 bits of a hash: buckets that rise along its order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")


def hashed_sql(*parts: str) -> str:
    """The same hash in SQL; parts are SQL expressions."""
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def fraction_sql(digest: str, first: int = 1, digits: int = DIGITS) -> str:
    return f"(('0x' || substr({digest}, {first}, {digits}))::BIGINT / {float(16 ** digits)!r}::DOUBLE)"

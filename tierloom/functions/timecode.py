"""Milliseconds, frames and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ms_to_frame(ms: Column | str, fps: Column | str) -> Column:
    """Frame that holds a time, cut toward zero."""
    return F.floor(_col(ms) * _col(fps) / 1000).cast("long")


def frame_to_ms(frame: Column | str, fps: Column | str) -> Column:
    return F.floor(_col(frame) * 1000 / _col(fps)).cast("long")


def stamp_to_ms(stamp: Column | str) -> Column:
    """``HH:MM:SS.mmm`` as milliseconds."""
    part = F.split(_col(stamp), "[:.]")
    return (F.try_element_at(part, F.lit(1)).cast("long") * 3_600_000
            + F.try_element_at(part, F.lit(2)).cast("long") * 60_000
            + F.try_element_at(part, F.lit(3)).cast("long") * 1000
            + F.try_element_at(part, F.lit(4)).cast("long"))


def ms_to_stamp(ms: Column | str) -> Column:
    ms = _col(ms).cast("long")

    def whole(unit: int) -> Column:
        return F.floor(ms / unit).cast("long")

    return F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000),
                           whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def seconds_to_stamp(seconds: Column | str) -> Column:
    """Seconds as a stamp; parts of a millisecond are cut off."""
    return ms_to_stamp(F.floor(_col(seconds) * 1000))

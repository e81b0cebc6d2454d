"""Store-local time. Valid for zones with whole-hour offsets and one-hour clock changes; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> tuple[Column, Column]:
    """(instant, wall clock) of a stripped text: one of them is null. A trailing Z means UTC. The shape is looked at first, as a parser that fails is slow."""
    instant = F.when(c.endswith("Z"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    shapes = ((r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d\d/\d\d/\d{4} \d\d:\d\d$", "MM/dd/yyyy HH:mm"))
    walls = [F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(form))) for shape, form in shapes]
    return instant, F.coalesce(*walls)


def to_utc(wall: Column, zone: Column) -> Column:
    """Instant of a wall clock reading: null if the clock shows it twice, the first instant after the gap if it is skipped."""
    u = F.to_utc_timestamp(wall, zone)
    skipped = F.from_utc_timestamp(u, zone) != wall
    twice = F.from_utc_timestamp(F.timestamp_add("HOUR", F.lit(1), u), zone) == wall
    return F.when(skipped, F.date_trunc("hour", u)).when(~twice, u)


def local_text(instant: Column, zone: Column) -> Column:
    """Wall clock with offset, like 2024-07-04 13:30:00-0500."""
    wall = F.from_utc_timestamp(instant, zone)
    minutes = ((F.unix_timestamp(wall) - F.unix_timestamp(instant)) / 60).cast("int")
    size = F.abs(minutes)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), offset)

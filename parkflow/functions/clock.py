"""Times: as text burned into pictures, in paths, and as intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plausible_year(year: Column, as_of_year: int) -> Column:
    """A year that no camera can show is the current one."""
    return F.when(year.between(2000, 2099), year).otherwise(F.lit(as_of_year))


def _timestamp(year: Column, month: Column, day: Column, hms: list[Column]) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    clock = F.concat_ws(":", *[F.lpad(x, 2, "0") for x in hms])
    return F.try_to_timestamp(F.concat_ws(" ", text, clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_clock_text(s: Column, as_of_year: int) -> Column:
    """struct(kind, seconds): `epoch` seconds of a date with time (Y-M-D, else M/D/Y, else D/M/Y), `time_of_day`
    seconds of a time alone, else null."""
    clock = r"(\d{2})[:.](\d{2})[:.](\d{2})"
    ymd, mdy = rf"(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})\s*{clock}", rf"(\d{{2}})[-/](\d{{2}})[-/](\d{{4}})\s*{clock}"
    part = lambda p, i: F.regexp_extract(s, p, i)
    time = lambda p: [part(p, i) for i in (4, 5, 6)]
    year = lambda p, i: plausible_year(part(p, i).try_cast("int"), as_of_year)
    stamp = F.coalesce(
        F.when(s.rlike(ymd), _timestamp(year(ymd, 1), part(ymd, 2), part(ymd, 3), time(ymd))),
        F.when(s.rlike(mdy), _timestamp(year(mdy, 3), part(mdy, 1), part(mdy, 2), time(mdy))),
        F.when(s.rlike(mdy), _timestamp(year(mdy, 3), part(mdy, 2), part(mdy, 1), time(mdy))),
    )
    hms = [part(clock, i).try_cast("int") for i in (1, 2, 3)]
    day = hms[0] * 3600 + hms[1] * 60 + hms[2]
    epoch = F.unix_timestamp(stamp).cast("double")
    found = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("seconds"))
    return F.when(epoch.isNotNull(), found("epoch", epoch)).when(day.isNotNull(), found("time_of_day", day))


def timestamp_from_path(path: Column) -> Column:
    """struct(kind, seconds) from a stem H-M-S and a folder YYYY-MM-DD; without such a folder, seconds of the day."""
    name = r"(?:^|/)(\d+)-(\d+)-(\d+)(?:-[^/]*)?(?:\.[^./]*)?$"
    hms = [F.regexp_extract(path, name, i).try_cast("int") for i in (1, 2, 3)]
    seconds = hms[0] * 3600 + hms[1] * 60 + hms[2]
    folder = r"(\d{4})-(\d{1,2})-(\d{1,2})/[^/]*$"
    year, month, day = (F.regexp_extract(path, folder, i) for i in (1, 2, 3))
    stamp = F.when(path.rlike(folder) & (hms[0] < 24) & (hms[1] < 60) & (hms[2] < 60), _timestamp(year, month, day, [x.cast("string") for x in hms]))
    found = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("seconds"))
    return F.when(seconds.isNotNull() & stamp.isNotNull(), found("epoch", F.unix_timestamp(stamp))).when(seconds.isNotNull(), found("time_of_day", seconds))


def resolve_timestamp(*sources: tuple[str, Column]) -> Column:
    """struct(source, kind, seconds) of the first source that has a time."""
    out = None
    for name, t in reversed(sources):
        own = F.struct(F.lit(name).alias("source"), t["kind"].alias("kind"), t["seconds"].alias("seconds"))
        out = F.when(t.isNotNull(), own) if out is None else F.when(t.isNotNull(), own).otherwise(out)
    return out


def frame_time(start: Column, frame: Column, fps: Column, first: int = 0) -> Column:
    """Seconds of a frame; an unusable frame rate counts as 30. first: number of the first frame."""
    return start + (frame - first) / F.when(fps > 0, fps).otherwise(F.lit(30.0))


def time_of_day(epoch: Column) -> Column:
    return F.pmod(F.floor(epoch), F.lit(86400))


def interval_floor(epoch: Column, minutes: int) -> Column:
    """Start of the interval; intervals begin anew each hour. 0: the time itself."""
    if not minutes:
        return epoch
    minute = F.floor(F.pmod(epoch, F.lit(3600)) / 60)
    return epoch - F.pmod(epoch, F.lit(60)) - 60 * (minute % minutes)


def format_hms(seconds: Column) -> Column:
    """H:M:S as on a clock; a day's worth of seconds is left out."""
    s = F.pmod(F.floor(seconds), F.lit(86400)).cast("int")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))

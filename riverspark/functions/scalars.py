"""Column expressions: units, labels, text repair, dates and local time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and standard-time hours west of UTC per region code.
CFS_TO_M3S = 0.028316846592
METRES_TO_MM = 1000.0
KELVIN_OFFSET = -273.15
UTC_MINUS = {
    "AK": 9,
    "YT": 8,
    "BC": 8,
    "NT": 7,
    "AB": 7,
    "NU": 7,
    "MB": 6,
    "SK": 6,
    "ON": 5,
    "QC": 5,
    "NL": 4,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def convert(c: Column | str, factor: float = 1.0, offset: float = 0.0) -> Column:
    """Linear unit conversion, ``c * factor + offset``."""
    scaled = _col(c) * F.lit(factor) if factor != 1.0 else _col(c)
    return scaled + F.lit(offset) if offset != 0.0 else scaled


def recode(c: Column | str, mapping: Mapping[str, str], keep_others: bool = True) -> Column:
    """Replace labels; labels outside the mapping stay or become NULL."""
    out = None
    for old, new in mapping.items():
        hit = _col(c) == F.lit(old)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    if out is None:
        return _col(c)
    return out.otherwise(_col(c)) if keep_others else out


def threshold_class(c: Column | str, cut: float, below: str, at_or_above: str) -> Column:
    """Two classes split at ``cut``; NULL stays NULL."""
    return F.when(_col(c) < cut, F.lit(below)).when(_col(c) >= cut, F.lit(at_or_above))


def pattern_class(c: Column | str, pattern: str, hit: str, miss: str) -> Column:
    """Label by whether the text holds a pattern."""
    return F.when(_col(c).rlike(pattern), F.lit(hit)).otherwise(F.lit(miss))


def sentence_case(c: Column | str) -> Column:
    """First letter kept, all others lower case."""
    return F.concat(F.left(_col(c), F.lit(1)), F.lower(F.substr(_col(c), F.lit(2))))


def variable_from_source(c: Column | str, prefix: int = 5) -> Column:
    """A4: variable tag of a file name such as ``clim-temp-2001.nc.csv``.

    Drops ``prefix`` leading characters, the separator with the year, and the
    file suffix.
    """
    tail = F.substr(_col(c), F.lit(prefix + 1))
    return F.regexp_replace(tail, r".[0-9]+|\.nc\.csv|\.csv", "")


def repair_exponent(c: Column | str) -> Column:
    """Give a mangled number such as ``1.2e.09`` its exponent sign back."""
    return F.regexp_replace(_col(c), r"e\.", "e+")


def glue_label(*parts: Column | str, sep: str = "-") -> Column:
    """I4: join text parts; NULL parts are left out."""
    return F.concat_ws(sep, *(_col(p).cast("string") for p in parts))


def pad_hour(c: Column | str) -> Column:
    """Hour as two digits."""
    return F.lpad(_col(c).cast("string"), 2, "0")


def split_composite(c: Column | str, part: int, pattern: str = r"[^A-Za-z0-9]+") -> Column:
    """Part ``part`` (from 1) of a composite name; NULL when there are fewer parts."""
    return F.try_element_at(F.split(_col(c), pattern), F.lit(part))


def jday_to_date(year: Column | str, jday: Column | str) -> Column:
    """I8: date of a day of the year."""
    return F.date_add(F.make_date(_col(year), F.lit(1), F.lit(1)), (_col(jday) - 1).cast("int"))


def mid_month(year: Column | str, month: Column | str) -> Column:
    """The 15th of a month, the date that stands for a monthly value."""
    return F.make_date(_col(year), _col(month), F.lit(15))


def epoch_to_timestamp(seconds: Column | str) -> Column:
    """Seconds since 1970 as a timestamp."""
    return F.timestamp_seconds(_col(seconds).cast("double"))


def utc_timestamp(date: Column | str, hour: Column | str) -> Column:
    """Start of an hour, from a date and an hour number."""
    return _col(date).cast("timestamp_ntz") + F.make_dt_interval(hours=_col(hour).cast("int"))


def utc_minus(region: Column | str) -> Column:
    """Hours a region's standard time lies behind UTC; no daylight saving."""
    out = None
    for code, hours in UTC_MINUS.items():
        hit = _col(region) == F.lit(code)
        out = F.when(hit, F.lit(hours)) if out is None else out.when(hit, F.lit(hours))
    return out


def local_timestamp(utc: Column | str, hours_behind: Column | str) -> Column:
    """Shift a UTC timestamp by a fixed number of hours."""
    return _col(utc) - F.make_dt_interval(hours=_col(hours_behind).cast("int"))


def percent_change(new: Column | str, old: Column | str) -> Column:
    """Change in per cent of the old value; NULL when the old value is zero."""
    return F.try_divide(_col(new) - _col(old), _col(old)) * 100

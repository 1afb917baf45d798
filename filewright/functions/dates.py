"""Dates in file names: calendar arithmetic that rolls over, two-digit years, capture times, and date formats."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.names import inherited, joined
from filewright.functions.patterns import date_format_of, date_pattern, group_count, optional_groups

DEFAULT_CAPTURE_FORMAT = "Y-m-d_H-i-s-v"
#: English names, in order.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Format characters that stand for whole formats.
WHOLE_FORMATS = {"c": r"Y-m-d\TH:i:sP", "r": "D, d M Y H:i:s O"}
#: Format characters that a zone has a part in, whole formats too.
_ZONED = set("eIOPpTZcrUB")


@dataclass(frozen=True)
class Moment:
    """A date, the second of the day, microseconds, and a zone as it was written (null: UTC)."""

    date: Column
    second: Column
    micro: Column
    zone: Column | None = None


def moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Moment:
    """Parts out of range roll over: February 31 is in March, hour 25 on the next day, month 0 in December before."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    total = hour * 3600 + minute * 60 + second
    date = F.date_add(first, (day - 1 + F.floor(total / 86400)).cast("int"))
    return Moment(date, F.pmod(total, F.lit(86400)), F.lit(0))


def moment_of(ts: Column, zone: Column | None = None) -> Moment:
    return Moment(F.to_date(ts), F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts), F.date_format(ts, "SSSSSS").cast("int"), zone)


def four_digit_year(two: Column) -> Column:
    """70 to 99 are of the last century."""
    return F.when(two >= 70, two + 1900).otherwise(two + 2000)


def _pick(names: list[str], index: Column, length: int | None = None) -> Column:
    return F.element_at(F.array(*[F.lit(n[:length]) for n in names]), index)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def formatted(format_: str, at: Moment) -> Column:
    """A date format with one character for each part; ``\\x`` is a literal x, other characters stand for themselves. Null without a date."""
    zone = F.lit(None).cast("string") if at.zone is None else at.zone
    parts = F.struct(at.date.alias("date"), at.second.alias("second"), at.micro.alias("micro"), zone.alias("zone"))
    return bound(parts, lambda p: _formatted(format_, Moment(p["date"], p["second"], p["micro"], p["zone"])))


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of a zone as it is written."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = F.left(digits, F.lit(2)).cast("int") * 3600 + F.right(digits, F.lit(2)).cast("int") * 60
    return F.when(F.startswith(zone, F.lit("+")), seconds).when(F.startswith(zone, F.lit("-")), -seconds).otherwise(0)


def _clock(offset: Column, between: str) -> Column:
    minutes = F.floor(F.abs(offset) / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.floor(minutes / 60)), F.lit(between), two(minutes % 60))


def _formatted(format_: str, at: Moment) -> Column:
    def number(width: int, x: Column) -> Column:
        text = x.cast("int").cast("string")
        if width == 1:
            return text
        # format_string is several times slower; only a year can be negative or too long
        plain = F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
        return F.when(x < 0, F.format_string(f"%0{width}d", x.cast("int"))).otherwise(plain) if width == 4 else plain

    zone, offset = F.coalesce(at.zone, F.lit("UTC")), F.coalesce(_offset(at.zone), F.lit(0))
    named = F.when(zone.rlike("^[+-]"), _clock(offset, ":")).otherwise(zone)
    since = F.datediff(at.date, F.make_date(F.lit(1970), F.lit(1), F.lit(1))).cast("long") * 86400 + at.second - offset
    year, month, day, hour = F.year(at.date), F.month(at.date), F.day(at.date), F.floor(at.second / 3600)
    twelve = F.pmod(hour + 11, F.lit(12)) + 1
    tokens = {
        "Y": lambda: number(4, year), "y": lambda: number(2, F.pmod(year, F.lit(100))),
        "m": lambda: number(2, month), "n": lambda: number(1, month),
        "d": lambda: number(2, day), "j": lambda: number(1, day),
        "H": lambda: number(2, hour), "G": lambda: number(1, hour), "h": lambda: number(2, twelve), "g": lambda: number(1, twelve),
        "i": lambda: number(2, F.floor(at.second / 60) % 60), "s": lambda: number(2, at.second % 60),
        "v": lambda: number(3, F.floor(at.micro / 1000)), "u": lambda: number(6, at.micro),
        "A": lambda: F.when(hour < 12, "AM").otherwise("PM"), "a": lambda: F.when(hour < 12, "am").otherwise("pm"),
        "N": lambda: number(1, F.weekday(at.date) + 1), "w": lambda: number(1, F.dayofweek(at.date) - 1), "z": lambda: number(1, F.dayofyear(at.date) - 1),
        "l": lambda: _pick(DAYS, F.weekday(at.date) + 1), "D": lambda: _pick(DAYS, F.weekday(at.date) + 1, 3),
        "F": lambda: _pick(MONTHS, month), "M": lambda: _pick(MONTHS, month, 3),
        "S": lambda: F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th"),
        "W": lambda: number(2, F.weekofyear(at.date)), "o": lambda: number(1, F.year(F.date_add(at.date, 3 - F.weekday(at.date)))),  # the year that the week's Thursday is in
        "t": lambda: number(1, F.day(F.last_day(at.date))), "L": lambda: F.when(F.day(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29, "1").otherwise("0"),
        "x": lambda: F.concat(F.when(year >= 10000, "+").otherwise(""), number(4, year)), "X": lambda: F.concat(F.when(year >= 0, "+").otherwise(""), number(4, year)),
        "e": lambda: named, "T": lambda: named, "I": lambda: F.lit("0"), "Z": lambda: offset.cast("string"), "O": lambda: _clock(offset, ""), "P": lambda: _clock(offset, ":"),
        "p": lambda: F.when(offset == 0, "Z").otherwise(_clock(offset, ":")), "U": lambda: since.cast("string"),
        "B": lambda: number(3, F.floor(F.pmod(since + 3600, F.lit(86400)) * 10 / 864)),
    }
    parts: list[Column] = []
    i = 0
    format_ = re.sub(r"(\\.)|([cr])", lambda m: m[1] or WHOLE_FORMATS[m[2]], format_)
    while i < len(format_):
        c = format_[i]
        if c == "\\" and i + 1 < len(format_):
            i += 1
            parts.append(F.lit(format_[i]))
        elif c in tokens:
            parts.append(tokens[c]())
        else:
            parts.append(F.lit(c))
        i += 1
    return F.when(at.date.isNotNull(), F.concat(*parts) if parts else F.lit(""))


#: Marks around what a date pattern matches; file names hold no such characters.
_MATCH, _GROUP = "\x00\x01", "\x00\x02"


def date_renamed(stem_: Column, ext: Column, pattern: str, replacement: str, strict: bool = True) -> Column:
    """The name with every date that a date pattern finds formatted anew, and the match's last capture group after each.

    Input is the name without a duplicate number; without a match it is unchanged. Parts that the pattern lacks are 0 (year, time) or 1
    (month, day). Trailing groups that take no part in a match don't count as its last group. One replacement marks all
    matches and their groups; the marked name is then taken apart.
    """
    compiled = date_pattern(pattern)
    groups, optional = group_count(compiled.java), optional_groups(compiled.java)
    listed = _GROUP.join(f"${k}" for k in range(groups + 1))
    format_ = date_format_of(replacement)

    def made(g: Column) -> Column:
        values: dict[str, Column] = {}
        for k, placeholder in enumerate(compiled.placeholders, 1):
            value = F.expr("try_cast(NULL AS INT)") if k > groups else F.get(g, F.lit(k)).try_cast("int")
            values["Y" if placeholder == "y" else placeholder] = four_digit_year(value) if placeholder == "y" else value
        at = moment(*(values.get(p, F.lit(default)) for p, default in (("Y", 0), ("m", 1), ("d", 1), ("H", 0), ("i", 0), ("s", 0))))
        # without capture groups the last group is the whole match
        last = [F.get(g, F.lit(k)) for k in range(groups, max(groups - optional, 0) - 1, -1)]
        return F.concat(formatted(format_, at), F.coalesce(*[F.nullif(x, F.lit("")) for x in last[:-1]], last[-1]))

    marked = F.regexp_replace(inherited(stem_, ext, strict), F.lit(compiled.java), F.lit(_MATCH + listed + _MATCH))
    each = lambda x, i: F.when(i % 2 == 1, bound(F.split(x, _GROUP), made)).otherwise(x)
    return F.array_join(F.transform(F.split(marked, _MATCH), each), "")


#: A capture time: a date with one kind of mark, and a time with seconds or without, fractions and zone if any. The image format's own marks, colons, need a time.
CAPTURE = r"^\s*(\d{4})(?:(-|/)(\d{1,2})\2|:(\d{2}):(?=\d{2}[T ]))(\d{1,2})(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?\s*$"


def _other_capture_time(original: Column) -> Column:
    """A capture time in another layout than the image format's, or with a day that its month hasn't: it rolls over. Null for months or days of 0, and for what no clock shows."""

    def made(g: Column) -> Column:
        part = lambda k: F.get(g, F.lit(k)).try_cast("int")
        month, day, hour, minute, second = part(1), part(2), *(F.coalesce(part(k), F.lit(0)) for k in (3, 4, 5))
        micro = F.rpad(F.get(g, F.lit(6)), 6, "0").try_cast("int")
        at = moment(part(0), month, day, hour, minute, second)
        seen = month.between(1, 12) & day.between(1, 31) & (hour <= 24) & (minute <= 59) & (second <= 60)
        return F.when(seen, F.timestamp_add("MICROSECOND", at.second.cast("long") * 1_000_000 + F.coalesce(micro, F.lit(0)), at.date.cast("timestamp_ntz")))

    parts = F.split(F.regexp_replace(original, CAPTURE, "$1,$3$4,$5,$6,$7,$8,$9"), ",")
    return F.when(original.rlike(CAPTURE), bound(parts, made))


def capture_zone(original: Column) -> Column:
    """The zone that a capture time ends in; null without one."""
    return F.nullif(F.when(original.rlike(CAPTURE), F.regexp_extract(original, CAPTURE, 10)), F.lit(""))


def capture_time(original: Column, sub_second: Column) -> Column:
    """Capture time, as the clock showed it, with its sub-seconds: over four characters are microseconds, up to four milliseconds."""
    ts = F.coalesce(F.try_to_timestamp(original, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"), _other_capture_time(original))
    n = F.coalesce(sub_second.try_cast("int"), F.lit(0))
    micro = F.when(F.length(sub_second) > 4, n).otherwise(n * 1000)
    return F.timestamp_add("MICROSECOND", micro, ts)


def capture_renamed(original: Column, sub_second: Column, ext: Column, format_: str = DEFAULT_CAPTURE_FORMAT, strict: bool = True) -> Column:
    """The capture time as a name with the file's own extension; null without a usable time."""
    zoned = any(c in _ZONED for c in re.sub(r"\\.", "", format_))
    zone = capture_zone(original) if zoned else F.lit(None).cast("string")
    parts = F.struct(capture_time(original, sub_second).alias("ts"), zone.alias("zone"))
    return joined(bound(parts, lambda p: formatted(format_, moment_of(p["ts"], p["zone"]))), ext, strict)

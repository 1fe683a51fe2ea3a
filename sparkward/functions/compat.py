"""Allowlisted functions whose Postgres meaning differs from the Spark builtin.

Everything else on the allowlist is the Spark builtin of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(value: Column) -> Column:
    """Collects NULLs too. The group's values must fit in one row."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s.getField("v"))


def concat(*parts: Column) -> Column:
    """Skips NULLs."""
    return F.concat_ws("", *parts)


def substring(text: Column, start: int, length: int) -> Column:
    """Positions before the first character count against the length."""
    end = start + length
    first = max(start, 1)
    return F.substring(text, first, max(end - first, 0))


def left(text: Column, n: int) -> Column:
    """A negative count drops that many characters from the end."""
    if n >= 0:
        return F.substring(text, 1, n)
    return F.substring(text, F.lit(1), F.greatest(F.length(text) + n, F.lit(0)))


def right(text: Column, n: int) -> Column:
    """A negative count drops that many characters from the start."""
    if n >= 0:
        return F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.length(text))
    return F.substring(text, F.lit(1 - n), F.length(text))


def strpos(text: Column, part: str) -> Column:
    return F.instr(text, part)


def initcap(text: Column) -> Column:
    """A word starts after anything that is neither letter nor digit."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    words = F.transform(
        runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    )
    return F.array_join(words, "")


# Date pattern letters, Postgres to Spark; the longer of two that fit comes first.
_DATE_PARTS = (
    ("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"),
    ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"),
    ("Mon", "MMM"), ("FMMonth", "MMMM"), ("Dy", "EEE"), ("FMDay", "EEEE"),
)


def date_pattern(postgres: str) -> str:
    """A Postgres date pattern in Spark's letters; other letters are refused, text in double quotes stays."""
    out, rest = "", postgres
    while rest:
        hit = next(((p, s) for p, s in _DATE_PARTS if rest.startswith(p)), None)
        if hit:
            out, rest = out + hit[1], rest[len(hit[0]):]
        elif rest[0] == '"':
            text, quote, rest = rest[1:].partition('"')
            if not quote:
                raise ValueError(f"the quote in '{postgres}' does not end")
            out += "'" + text.replace("'", "''") + "'"
        elif rest[0].isalpha():
            raise ValueError(f"'{rest}' in the pattern '{postgres}' is not supported")
        else:
            out, rest = out + ("''" if rest[0] == "'" else rest[0]), rest[1:]
    return out


# The fields of make_interval, in order.
INTERVAL_FIELDS = ("years", "months", "weeks", "days", "hours", "mins", "secs")


@dataclass(frozen=True)
class NumberPattern:
    """A Postgres number pattern: Spark's pattern of all digits, which leading signs are blank, what FM cuts off."""

    digits: str
    blanked: str
    trailing: str
    fill: bool
    places: int
    width: int


def number_pattern(postgres: str) -> NumberPattern:
    """9, 0, the comma and the point, with FM before them; other signs are refused."""
    fill = not postgres.upper().startswith("FM")
    body = postgres if fill else postgres[2:]
    whole, point, part = body.partition(".")
    if not body or set(body) - set("90,.") or set(part) - set("90") or not set(whole) & set("90"):
        raise ValueError(f"the number pattern '{postgres}' is not supported")
    forced = whole.find("0")
    blank = forced if forced >= 0 else len(whole) - (0 if point else 1)
    cut = part[part.rfind("0") + 1 :]
    trailing = rf"(?<=\.\d{{{len(part) - len(cut)},{len(part)}}})0+$" if cut else ""
    return NumberPattern(body.replace("9", "0"), f"^[0,]{{0,{blank}}}", trailing, fill, len(part), len(body))


def interval_text(value: Column) -> Column:
    """A calendar interval as Postgres writes it: '1 year 2 mons 3 days 04:05:06'."""
    text = value.cast("string")

    def of(unit: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, rf"(-?[\d.]+) {unit}", 1), F.lit("")), F.lit("0"))

    def field(unit: str, name: str) -> Column:
        n = of(unit).cast("int")
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s"))))

    hours, minutes, seconds = of("hours").cast("int"), of("minutes").cast("int"), of("seconds").cast("decimal(18,6)")
    sign = F.when((hours < 0) | (minutes < 0) | (seconds < 0), F.lit("-")).otherwise(F.lit(""))
    rest = F.abs(seconds)
    whole = F.floor(rest).cast("long")
    part = F.regexp_replace(F.format_string("%06d", ((rest - whole) * 1_000_000).cast("int")), "0+$", "")
    clock = F.format_string("%s%02d:%02d:%02d%s", sign, F.abs(hours), F.abs(minutes), whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
    timed = (hours != 0) | (minutes != 0) | (seconds != 0)
    dated = F.concat_ws(" ", field("years", "year"), field("months", "mon"), field("days", "day"))
    return F.when(value.isNull(), F.lit(None)).when(timed, F.trim(F.concat_ws(" ", dated, clock))).otherwise(F.when(dated == "", F.lit("00:00:00")).otherwise(dated))


def to_char(when: Column, pattern: str) -> Column:
    return F.date_format(when, date_pattern(pattern))


def encode(value: Column, form: str) -> Column:
    if form == "base64":
        return F.base64(value)
    if form == "hex":
        return F.lower(F.hex(value))
    raise ValueError(f"unknown encoding '{form}'")


def trunc(value: Column, places: int = 0) -> Column:
    """Cuts digits off towards zero; exact for decimals."""
    scale = 10**places
    up = value * scale
    return F.when(value >= 0, F.floor(up)).otherwise(F.ceil(up)) / scale


def round_double(value: Column, places: int = 0) -> Column:
    """Halves go to the even neighbour, as they do for doubles; decimals round up."""
    return F.bround(value, places)


def int_div(left: Column, right: Column) -> Column:
    """Integer division, towards zero; by zero it is an error."""
    return F.call_function("div", left, right)


def sqrt(value: Column) -> Column:
    """The root of a negative number is an error, not NaN."""
    ok = F.when(value < 0, F.raise_error(
        F.lit("cannot take square root of a negative number")).cast("double")).otherwise(value)
    return F.sqrt(ok)


def generate_series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """Every value from start to stop, stop included, as rows; a step that leads away
    from the stop gives none."""
    step = F.lit(1) if step is None else step
    empty = ((step > 0) & (start > stop)) | ((step < 0) & (start < stop))
    return F.explode(F.when(~empty, F.sequence(start, stop, step)))


def make_interval(
    years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, mins: int = 0,
    secs: float = 0,
) -> Column:
    """An interval to add to a moment; on its own it has no place in a result."""
    return F.make_interval(*map(F.lit, (years, months, weeks, days, hours, mins, secs)))


def log(value: Column, base: Column | None = None) -> Column:
    """Base 10 unless a base is given. Zero and below is an error, not NULL."""
    ok = F.when(value > 0, value).otherwise(
        F.raise_error(F.lit("cannot take logarithm of zero or a negative number")).cast("double")
    )
    return F.log10(ok) if base is None else F.ln(ok) / F.ln(base)


def epoch(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp")) / F.lit(1_000_000)


def day_of_week(when: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(when) - 1


def age(later: Column, earlier: Column) -> Column:
    """Months, days and microseconds between two moments, as a struct; negative if they are the other way round.

    Field by field: a day is borrowed for a time of day that is earlier, and the days of
    the earlier moment's month for a day of the month that is.
    """
    low, high = (f(later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")) for f in (F.least, F.greatest))
    of_day = lambda t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp"))
    micros = of_day(high) - of_day(low)
    day_borrowed = F.when(micros < 0, 1).otherwise(0)
    days = F.dayofmonth(high) - F.dayofmonth(low) - day_borrowed
    month_borrowed = F.when(days < 0, 1).otherwise(0)
    months = 12 * (F.year(high) - F.year(low)) + F.month(high) - F.month(low) - month_borrowed
    sign = F.when(later.cast("timestamp_ntz") < earlier.cast("timestamp_ntz"), -1).otherwise(1)
    return F.struct(
        (sign * months).cast("int").alias("months"),
        (sign * (days + month_borrowed * F.dayofmonth(F.last_day(low)))).cast("int").alias("days"),
        (sign * (micros + day_borrowed * F.lit(86_400_000_000))).cast("bigint").alias("micros"),
    )


def json_path_text(value: Column, *path: str) -> Column:
    return F.get_json_object(value, "$." + ".".join(path))

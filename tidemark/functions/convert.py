"""Conversion of change-event and snapshot texts to what a target takes: column expressions by logical type, which users can add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """A text that isn't a whole number is null."""
    return x.cast("string").try_cast("bigint")


def over(x: Column, n: int) -> Column:
    """x / n, rounded down, without a detour over floating-point numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def _day(days: Column) -> Column:
    """Years after 9999 without the plus that Spark puts before them."""
    return F.ltrim(F.date_from_unix_date(days.cast("int")).cast("string"), F.lit("+"))


def epoch_date(x: Column) -> Column:
    """Days since 1970 as yyyy-MM-dd."""
    return _day(whole(x))


def _clock(seconds: Column) -> Column:
    part = lambda n, most: F.lpad(F.pmod(over(seconds, n), F.lit(most)).cast("string"), 2, "0")
    return F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))


def _instant(seconds: Column, between: str = " ") -> Column:
    """Day and time of seconds since 1970, in UTC whatever the session's zone."""
    return F.concat(_day(over(seconds, 86400)), F.lit(between), _clock(F.pmod(seconds, F.lit(86400))))


def _fraction(x: Column, digits: int) -> Column:
    rest = F.pmod(x, F.lit(10**digits))
    return F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), digits, "0"), "0+$", "")))


def millis_timestamp(x: Column) -> Column:
    """Fractions of a second are cut off."""
    return _instant(over(whole(x), 1000))


def micros_timestamp(x: Column) -> Column:
    """With a T and the fraction, its trailing zeros trimmed."""
    return F.concat(_instant(over(whole(x), 1_000_000), "T"), _fraction(whole(x), 6))


def nanos_timestamp(x: Column) -> Column:
    """As micros_timestamp(). Numbers of up to 23 digits, as 64 bits end in 2262."""
    text = x.cast("string")
    nanos = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("decimal(23,0)"))
    return F.concat(_instant(over(nanos, 1_000_000_000), "T"), _fraction(nanos, 9))


def millis_time(x: Column) -> Column:
    return _clock(over(whole(x), 1000))


def micros_time(x: Column) -> Column:
    """With six digits of the second's fraction."""
    return F.concat(_clock(over(whole(x), 1_000_000)), F.lit("."), F.lpad(F.pmod(whole(x), F.lit(1_000_000)).cast("string"), 6, "0"))


def zoned_timestamp(x: Column) -> Column:
    """An ISO text with a zone, in UTC."""
    return F.concat(_instant(F.unix_seconds(F.try_to_timestamp(x)), "T"), F.lit("Z"))


def _bytes(x: Column) -> Column:
    """The numbers 0 to 255 of base64 text; none of empty text."""
    digits = F.hex(F.unbase64(x))
    places = F.when(digits == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1))
    return F.transform(places, lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


#: The length that stands for a bit string of varying length (fixed value).
VARYING = 2147483647


def bits(x: Column, length: Column | int | None = None) -> Column:
    """Base64 of little-endian bytes, however many, as binary digits: as many as length says at least, or, without a length and
    for varying ones, none more than the number needs."""
    turned = F.array_join(F.transform(F.reverse(_bytes(x)), lambda n: F.lpad(F.conv(n.cast("string"), 10, 2), 8, "0")), "")
    number = F.regexp_replace(turned, "^0+", "")
    given = length if isinstance(length, Column) else F.lit(length or 0)
    width = F.when(F.coalesce(given, F.lit(0)).isin(0, VARYING), 1).otherwise(given)
    return F.when(F.length(number) < width, F.lpad(number, width, F.lit("0"))).otherwise(number)


def hex_bytes(x: Column) -> Column:
    """Base64 as \\x and hex digits."""
    return F.concat(F.lit("\\x"), F.lower(F.hex(F.unbase64(x))))


def quoted(x: Column) -> Column:
    """As a literal: in quotes, quotes doubled."""
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def hstore(x: Column) -> Column:
    """A map as "key"=>"value" pairs by key; quotes and backslashes are escaped, null values are NULL."""

    def text(y: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(y, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    pairs = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(text(e["key"]), F.lit("=>"), F.coalesce(text(e["value"]), F.lit("NULL"))))
    return F.array_join(pairs, ",")


def _part(x: Column, number: str, unit: str, kind: str) -> Column:
    return F.coalesce(F.regexp_extract(x, f"({number}){unit}", 1).try_cast(kind), F.lit(0).cast(kind))


def year_month_interval(x: Column) -> Column:
    """P-1Y-5M0DT0H0M0S as -1-5: the sign of any part stands once, in front."""
    years, months = (_part(F.split_part(x, F.lit("T"), F.lit(1)), "-?[0-9]+", unit, "bigint") for unit in "YM")
    return F.concat(F.when(x.isNull(), None).when((years < 0) | (months < 0), "-").otherwise(""), F.abs(years).cast("string"), F.lit("-"), F.abs(months).cast("string"))


def day_second_interval(x: Column) -> Column:
    """P0Y0M24DT23H34M5.878667S as 24 23:34:5.878667000: the sign of any part stands once, in front; minutes are those behind the T."""
    days = _part(F.split_part(x, F.lit("T"), F.lit(1)), "-?[0-9]+", "D", "bigint")
    time = F.split_part(x, F.lit("T"), F.lit(2))
    hours, minutes = (_part(time, "-?[0-9]+", unit, "bigint") for unit in "HM")
    seconds = _part(time, r"-?[0-9]+(?:\.[0-9]+)?", "S", "decimal(28,9)")
    negative = (days < 0) | (hours < 0) | (minutes < 0) | (seconds < 0)
    return F.concat(F.when(x.isNull(), None).when(negative, "-").otherwise(""), F.abs(days).cast("string"), F.lit(" "), F.concat_ws(":", F.abs(hours).cast("string"), F.abs(minutes).cast("string"), F.abs(seconds).cast("string")))


def _day_first(day: Column) -> Column:
    return F.concat_ws("-", F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), F.lpad(F.month(day).cast("string"), 2, "0"), F.lpad(F.year(day).cast("string"), 4, "0"))


def oracle_date(x: Column) -> Column:
    """Days since 1970 as dd-MM-yyyy."""
    days = whole(x)
    return F.when(days.isNotNull(), _day_first(F.date_from_unix_date(days.cast("int"))))


def oracle_timestamp(x: Column) -> Column:
    """Milliseconds since 1970 as dd-MM-yyyy HH:mm:ss.SSS, in UTC."""
    n = whole(x)
    day = _day_first(F.date_from_unix_date(over(n, 86_400_000).cast("int")))
    return F.when(n.isNotNull(), F.concat(day, F.lit(" "), _clock(over(F.pmod(n, F.lit(86_400_000)), 1000)), F.lit("."), F.lpad(F.pmod(n, F.lit(1000)).cast("string"), 3, "0")))


#: Decimal digits of a limb in the arithmetic on numbers of any size.
LIMB = 9


def variable_decimal(scale: Column, value: Column) -> Column:
    """A decimal of its own scale and any size, sent as base64 of the big-endian two's-complement number."""
    raw = _bytes(value)
    negative = F.coalesce(F.get(raw, F.lit(0)) >= 128, F.lit(False))
    # The amount of a negative number: all bits turned, plus one.
    amount = F.transform(raw, lambda n, k: F.when(negative, 255 - n + (k == F.size(raw) - 1).cast("bigint")).otherwise(n))
    none = F.array().cast("array<bigint>")
    state = lambda carry, limbs: F.struct(carry.cast("bigint").alias("carry"), limbs.alias("limbs"))

    def shifted(limbs: Column, byte: Column) -> Column:
        """limbs * 256 + byte, limbs the least first."""
        step = lambda s, x: state(over(x * 256 + s["carry"], 10**LIMB), F.concat(s["limbs"], F.array(F.pmod(x * 256 + s["carry"], F.lit(10**LIMB)))))
        return F.aggregate(limbs, state(byte, none), step, lambda s: F.concat(s["limbs"], F.array(s["carry"])))

    limbs = F.aggregate(amount, none, shifted)
    digits = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda n: F.lpad(n.cast("string"), LIMB, "0")), ""), "^0+(?=.)", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    text = F.concat(F.repeat(F.lit("0"), F.greatest(scale + 1 - F.length(digits), F.lit(0))), digits)
    left = F.left(text, F.length(text) - scale)
    return F.concat(F.when(negative, "-").otherwise(""), left, F.when(scale > 0, F.concat(F.lit("."), F.right(text, scale))).otherwise(""))


def gigabytes(x: Column) -> Column:
    return x / (1 << 30)


def title(x: Column) -> Column:
    """snake_case as Title Case."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


#: By logical type: a function of the text and the column's length. Add your own.
CONVERTERS: dict[str, Callable[[Column, Column], Column]] = {
    "date": lambda x, _: epoch_date(x), "timestamp": lambda x, _: millis_timestamp(x), "micro_timestamp": lambda x, _: micros_timestamp(x), "nano_timestamp": lambda x, _: nanos_timestamp(x),
    "time": lambda x, _: millis_time(x), "micro_time": lambda x, _: micros_time(x), "zoned_timestamp": lambda x, _: zoned_timestamp(x), "bits": bits, "bytes": lambda x, _: hex_bytes(x),
    "year_month": lambda x, _: year_month_interval(x), "day_second": lambda x, _: day_second_interval(x),
}


def resolve_type(source_type: Column, logical: Column, primitive: Column, oracle: bool = False) -> Column:
    """Which type decides: the source's for Oracle dates and intervals, then the logical name, then the primitive one."""
    special = F.upper(source_type).rlike("^(DATE|TIMESTAMP|INTERVAL)")
    return F.coalesce(F.when(special & F.lit(oracle), source_type), logical, primitive)


def convert_values(df: DataFrame, column_types: dict[str, tuple[str, int | None]], quote: bool = False) -> DataFrame:
    """df with each listed column (its logical type and length) converted; unlisted types stay as they are. Works on streams too."""

    def one(name: str, kind: str, length: int | None) -> Column:
        made = CONVERTERS.get(kind, lambda x, _: x)(F.col(name), F.lit(length or 0))
        return quoted(made) if quote else made

    return df.withColumns({x: one(x, *kind) for x, kind in column_types.items()})


def convert_fields(df: DataFrame, column_types: dict[str, tuple[str, int | None]], maps: tuple[str, ...] = ("key", "fields")) -> DataFrame:
    """Events with the values of key and fields converted by column name; before_fields aren't."""

    def each(name: Column, value: Column) -> Column:
        out = value
        for x, (kind, length) in column_types.items():
            out = F.when(name == x, CONVERTERS.get(kind, lambda v, _: v)(value, F.lit(length or 0))).otherwise(out)
        return out

    return df.withColumns({x: F.transform_values(x, each) for x in maps})

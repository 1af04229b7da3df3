"""Cell coercions. Bad values become null; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: date layouts in the order they are tried.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "M/d/yy", "M-d-yyyy")
#: Fixed value: layouts that must not lie in the future.
SHORT_FORMATS = ("yy/M/d", "yy-M-d", "yy.M.d")
EPOCH = "1899-12-30"


#: Full-width forms of the printable ASCII characters, by rule: each lies 0xFEE0 above its half-width form; the wide space is the last.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def half_width(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def cell_text(text: Column, number: Column | None = None) -> Column:
    """Text of a cell: integral numbers without a fraction, text trimmed, nothing as empty."""
    shown = F.trim(text)
    if number is not None:
        shown = F.coalesce(shown, F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string")))
    return F.coalesce(shown, F.lit(""))


def _two_digit(s: Column, fmt: str) -> Column:
    """Years 69 to 99 of two digits belong to the last century."""
    d = F.to_date(F.try_to_timestamp(s, F.lit(fmt)))
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_date(text: Column, as_of: Column, number: Column | None = None, stamp: Column | None = None) -> Column:
    """The date of a cell: time stamps, serial numbers, then the layouts in order; short layouts not after as_of."""
    s = F.trim(half_width(text))
    tried = [_two_digit(s, f) if "yyyy" not in f else F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS]
    for f in SHORT_FORMATS:
        d = _two_digit(s, f)
        tried.append(F.when(d <= as_of, d))
    part = lambda i: F.regexp_extract(s, r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})", i)
    tried.append(F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-M-d"))))
    if number is not None:
        tried.insert(0, F.date_add(F.lit(EPOCH).cast("date"), F.floor(number).cast("int")))
    if stamp is not None:
        tried.insert(0, F.to_date(stamp))
    return F.coalesce(*tried)


def parse_number(text: Column) -> Column:
    """Full-width digits and thousands commas are understood."""
    return F.replace(F.trim(half_width(text)), F.lit(",")).try_cast("double")


def parse_int(text: Column) -> Column:
    """Cut towards zero."""
    return parse_number(text).try_cast("bigint")


def magnitude_int(text: Column) -> Column:
    """1.2万 and 1.2w are 12000, fractions cut off; else a number without its commas; else null."""
    s = F.trim(text)
    large = (F.regexp_extract(s, r"^(.*?)[万wW]+$", 1).try_cast("double") * 10000).try_cast("bigint")
    return F.when(s.rlike("[万wW]$"), large).otherwise(parse_int(s))


def epoch_text(value: Column) -> Column:
    """Epoch seconds or milliseconds (above 1e12) as yyyy-MM-dd HH:mm:ss in the session's zone."""
    return F.date_format(F.when(value > 1e12, F.timestamp_millis(value.cast("bigint"))).otherwise(F.timestamp_seconds(value.cast("bigint"))), "yyyy-MM-dd HH:mm:ss")


def thousands(value: Column) -> Column:
    return F.format_string("%.1fK", value / 1000)


def is_home_market(country: Column) -> Column:
    """The two spellings of the home market."""
    return F.upper(F.replace(country, F.lit(" "), F.lit(""))).isin("MAINLANDCHINA", "CHINA")


def followers_in_thousands(count: Column) -> Column:
    """Counts of 10 000 and more were given in units."""
    return F.when(count >= 10000, count / 1000).otherwise(count)

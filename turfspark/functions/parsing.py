"""Column expressions that take values out of the raw texts. A text that doesn't fit gives null, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import OTHER_PLACE, PLACES, RACE_TYPES


_END = "\x01"  # ends a part of a text; texts that have it themselves fit no pattern


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, null without one."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def number(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group as an integer, null without one."""
    return F.regexp_extract(_col(text), pattern, group).try_cast("int")


def code_map(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def whole(text: Column | str) -> Column:
    """Digits as an integer, anything else null."""
    return F.trim(_col(text)).try_cast("int")


def sex(sex_age: Column | str) -> Column:
    return F.nullif(F.substring(_col(sex_age), 1, 1), F.lit(""))


def age(sex_age: Column | str) -> Column:
    return F.substring(_col(sex_age), 2, 10).try_cast("int")


_WEIGHT = r"^\s*(\d+)\s*\(\s*([+-]?\d+)\s*\)\s*$"


def weight(text: Column | str) -> Column:
    """480 of ``480(+4)``; also of a weight without a change."""
    return found(text, r"^\s*(\d+)").try_cast("int")


def weight_change(text: Column | str) -> Column:
    return found(text, _WEIGHT, 2).try_cast("int")


def first_corner(passing: Column | str) -> Column:
    return number(passing, r"(\d+)")


def final_corner(passing: Column | str) -> Column:
    return number(passing, r"(\d+)\D*$")


def place_code(text: Column | str) -> Column:
    """``05`` of ``1東京3``; 99 for a place that has no code."""
    return F.coalesce(F.element_at(code_map(PLACES), F.regexp_extract(_col(text), r"(\D+)", 1)), F.lit(OTHER_PLACE))


def race_type(course: Column | str) -> Column:
    """``ダート`` of ``ダ1150``."""
    return F.element_at(code_map(RACE_TYPES), F.regexp_extract(_col(course), r"(\D+)", 1))


def hundreds(distance: Column | str) -> Column:
    """Distance in whole hundreds of metres: 11 of 1150 or of ``ダ1150``."""
    return F.floor(number(_col(distance).cast("string"), r"(\d+)") / 100).cast("int")


def race_seconds(time: Column | str) -> Column:
    """94.5 of ``1:34.5``, ``1.34.5`` or ``1:34:5``."""
    pattern = r"^\s*(\d+)(?::(\d{1,2})[.:]|\.(\d{1,2})\.)(\d+)\s*$"
    parts = F.split(F.regexp_replace(_col(time), pattern, f"$1{_END}$2$3{_END}$4{_END}"), _END)  # matched once; what doesn't fit is left as it is
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    fraction = F.concat(F.lit("0."), F.get(parts, F.lit(2))).try_cast("double")
    return F.when(~F.contains(_col(time), F.lit(_END)), part(0) * 60 + part(1) + fraction)


def japanese_date(text: Column | str) -> Column:
    """Of ``2024年2月3日``."""
    parts = [found(text, r"(\d{4})年(\d{1,2})月(\d{1,2})日", k) for k in (1, 2, 3)]
    return F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")).try_cast("date")


def slashed_date(text: Column | str) -> Column:
    """Of ``2024/02/03``, or an ISO date."""
    return F.replace(_col(text), F.lit("/"), F.lit("-")).try_cast("date")


def post_timestamp(date: Column | str, time: Column | str) -> Column:
    """From a date (or the date part of a timestamp text) and ``HH:MM`` or ``HH:MM:SS``."""
    day = F.element_at(F.split(F.trim(_col(date).cast("string")), " "), 1)
    return F.concat_ws(" ", day, F.trim(_col(time))).try_cast("timestamp")


def zero_padded(text: Column | str, width: int) -> Column:
    """Leading zeros up to ``width``; longer texts stay whole."""
    c = _col(text).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def ascii_digits(text: Column | str) -> Column:
    return F.translate(_col(text), "０１２３４５６７８９", "0123456789")


def race_place(race_id: Column | str) -> Column:
    return F.substring(_col(race_id), 5, 2)


def race_number(race_id: Column | str) -> Column:
    return F.substring(_col(race_id), 11, 2)

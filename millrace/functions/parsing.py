"""Column expressions that parse text, within whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?(?i:inf|infinity)$"
# Dates are cut into fields by one pattern; each form fills some of the fields, and the others are empty.
_Y, _ONE, _NAME = r"(\d{4})", r"(\d{1,2})", r"([A-Za-z]{3,9}+)\.?"
_FORMS = (
    f"{_Y}[-/]{_ONE}[-/]{_ONE}",  # groups 1 to 3: year, month, day
    r"(\d{4})(\d{2})(\d{2})",  # 4 to 6: year, month, day
    f"{_ONE}[-/]{_ONE}[-/]{_Y}",  # 7 to 9: month and day in either order, year
    f"{_NAME} {_ONE},? {_Y}",  # 10 to 12: name, day, year
    f"{_ONE}[ -]{_NAME},?[ -]{_Y}",  # 13 to 15: day, name, year
)
_TIME = r"(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?: ?([AaPp])[Mm])? ?(?:(Z)|([+-]\d{2}):?(\d{2}))?)?"  # 16 to 20: hour to half of the day, 21 to 23: zone
_MOMENT = f"^(?:(?:{'|'.join(_FORMS)}){_TIME}|(\\d{{4}}))$"  # 24: a year alone
_MARK = "\x01"
_FIELDS = {
    "year": "$1$4$9$12$15$24", "month": "$2$5", "day": "$3$6", "one": "$7", "two": "$8", "name": "$10$14", "named_day": "$11$13",
    "hour": "$16", "minute": "$17", "second": "$18", "fraction": "$19", "half": "$20", "zone_hour": "$22", "zone_minute": "$23", "alone": "$24",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def strip(text: Column) -> Column:
    """Without white space at both ends: space, tab and line ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(~F.regexp_like(text, F.lit(r"^\s*$")), text)


def parse_number(text: Column) -> Column:
    """A double, or null: no digit separators, type suffixes or hexadecimals; NaN is null."""
    value = strip(text)
    infinite = F.when(F.startswith(value, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.regexp_like(value, F.lit(_NUMBER)), value.try_cast("double")).when(F.regexp_like(value, F.lit(_INFINITE)), infinite)


def parse_boolean(text: Column) -> Column:
    value = F.lower(strip(text))
    return F.when(value.isin(*TRUE_WORDS), F.lit(True)).when(value.isin(*FALSE_WORDS), F.lit(False))


def parse_datetime(text: Column) -> Column:
    """A timestamp without zone, or null; an offset is turned into UTC. Month first where both orders fit.

    A date may be followed by a time, of 12 hours with AM or PM, and that by a
    zone; months may be named in English, whole or by three letters.
    """
    value = strip(text)
    # Other text has no fields, and all that follows is null at once; this is no condition around the rest, so the fields are cut once for each row.
    cut = F.split(F.when(F.regexp_like(value, F.lit(_MOMENT)), F.regexp_replace(value, _MOMENT, _MARK + _MARK.join(_FIELDS.values()))), _MARK)
    field = {name: F.get(cut, F.lit(k + 1)) for k, name in enumerate(_FIELDS)}
    number = {name: F.when(c != "", c).try_cast("int") for name, c in field.items() if name not in ("name", "half")}
    name = F.lower(field["name"])
    place = F.lit(0)
    for k, month in reversed(list(enumerate(MONTHS, 1))):
        place = F.when(name.isin(month, month[:3], *(["sept"] if k == 9 else [])), k).otherwise(place)
    hour = F.when(field["half"] == "", number["hour"]).when(number["hour"].between(1, 12), number["hour"] % 12 + F.when(F.lower(field["half"]) == "p", 12).otherwise(0))
    hour = F.when(field["hour"] == "", 0).otherwise(hour)
    seconds = F.concat(F.when(field["second"] == "", "0").otherwise(field["second"]), F.lit("."), F.rpad(F.substring(field["fraction"], 1, 6), 6, "0")).try_cast("decimal(16,6)")
    at = lambda month, day: F.try_make_timestamp_ntz(number["year"], month, day, hour, F.coalesce(number["minute"], F.lit(0)), seconds)
    first = F.when(field["one"] != "", number["one"]).when(field["name"] != "", place).when(field["alone"] != "", 1).otherwise(number["month"])
    second = F.when(field["one"] != "", number["two"]).when(field["name"] != "", number["named_day"]).when(field["alone"] != "", 1).otherwise(number["day"])
    moment = F.coalesce(at(first, second), F.when(field["one"] != "", at(number["two"], number["one"])))
    ahead = F.coalesce(number["zone_hour"], F.lit(0)) * 60 + F.when(F.startswith(field["zone_hour"], F.lit("-")), -1).otherwise(1) * F.coalesce(number["zone_minute"], F.lit(0))
    return F.when(field["zone_hour"] == "", moment).otherwise(moment - F.make_dt_interval(F.lit(0), F.lit(0), ahead))


def word_count(text: Column) -> Column:
    """Words between white space; blank text has none."""
    value = strip(text)
    return F.when(value == "", 0).otherwise(F.size(F.split(value, r"\s+")))

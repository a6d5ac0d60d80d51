"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

# Letters that do not decompose to ASCII by themselves, and the
# accented letters of the Nordic alphabets, with their plain spelling.
_PLAIN_LETTERS = {
    "á": "a", "à": "a", "â": "a", "ä": "a", "å": "a", "ã": "a",
    "é": "e", "è": "e", "ê": "e", "ë": "e",
    "í": "i", "ì": "i", "î": "i", "ï": "i",
    "ó": "o", "ò": "o", "ô": "o", "ö": "o", "ø": "o", "õ": "o",
    "ú": "u", "ù": "u", "û": "u", "ü": "u",
    "ý": "y", "ÿ": "y", "ð": "d", "ñ": "n", "ç": "c",
}
_TWO_LETTERS = {"þ": "th", "Þ": "TH", "æ": "ae", "Æ": "AE", "ß": "ss", "œ": "oe", "Œ": "OE"}

EXCEL_DAY_ZERO = date(1899, 12, 30)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_name(first: Column | str, last: Column | str) -> Column:
    """First and last name joined by a blank; NULL when both are empty."""
    both = F.concat(F.coalesce(col(first), F.lit("")), F.lit(" "), F.coalesce(col(last), F.lit("")))
    return F.nullif(F.trim(both), F.lit(""))


def nights(arrival: Column | str, departure: Column | str) -> Column:
    """Nights between two dates, zero for day use."""
    return F.greatest(F.datediff(col(departure), col(arrival)), F.lit(0))


def month_of(c: Column | str) -> Column:
    """First day of the month of a date or timestamp, as a date."""
    return F.trunc(col(c).cast("date"), "month")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` at two decimals, half away from zero; NULL for a zero whole."""
    exact = (part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
             / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    return F.round(exact, 2).cast("decimal(14,2)")


def whole(c: Column) -> Column:
    """Round to a whole number, half away from zero (a bare cast would cut off)."""
    return F.round(c, 0).cast("bigint")


def plain_ascii(c: Column | str) -> Column:
    """Replace accented letters by their plain spelling."""
    out = col(c)
    for letter, spelling in _TWO_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    lower, lower_to = "".join(_PLAIN_LETTERS), "".join(_PLAIN_LETTERS.values())
    upper = "".join(k.upper() for k in _PLAIN_LETTERS if len(k.upper()) == 1)
    upper_to = "".join(v.upper() for k, v in _PLAIN_LETTERS.items() if len(k.upper()) == 1)
    return F.translate(out, lower + upper, lower_to + upper_to)


def moment(as_of: date | datetime) -> Column:
    """The point in time ``as_of`` as a zone-free timestamp literal."""
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def day(as_of: date | datetime) -> Column:
    """The calendar day of ``as_of`` as a date literal."""
    return F.lit(as_of.date() if isinstance(as_of, datetime) else as_of)


def months_before(as_of: date | datetime, months: int) -> Column:
    """``as_of`` moved back by whole months; month ends are clamped."""
    back = F.make_ym_interval(F.lit(0), F.lit(months))
    return (moment(as_of) - back) if isinstance(as_of, datetime) else F.add_months(day(as_of), -months)


def later(ts: Column, **parts: int) -> Column:
    """``ts`` moved forward by days, hours, mins or secs."""
    return ts + F.make_dt_interval(*(F.lit(parts.get(p, 0)) for p in ("days", "hours", "mins", "secs")))


def at_midnight(c: Column | str) -> Column:
    """A date as the zone-free timestamp of its midnight."""
    return col(c).cast("timestamp_ntz")


def hotel_local_date(c: Column | str, timezone: Column | str) -> Column:
    """Calendar day of a UTC time at the hotel, whose zone is a column."""
    return F.convert_timezone(F.lit("UTC"), col(timezone), col(c).cast("timestamp_ntz")).cast("date")


def excel_serial(c: Column | str) -> Column:
    """Spreadsheet serial day number to a timestamp, exact to the second."""
    serial = col(c).cast("double")
    whole_days = F.floor(serial).cast("int")
    secs = F.round((serial - F.floor(serial)) * 86400).cast("int")
    start = F.date_add(F.lit(EXCEL_DAY_ZERO), whole_days).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def hash_number(key: Column, seed: str = "") -> Column:
    """A repeatable number below 2^32 for a key, from the md5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")


def hash_share(key: Column, share: float, seed: str = "") -> Column:
    """True for a repeatable ``share`` of the keys (stands in for random sampling)."""
    return hash_number(key, seed) < F.lit(int(share * 2 ** 32))


def weighted_pick(unit: Column, weights: dict[str, float]) -> Column:
    """The first choice whose running weight reaches ``unit`` times the weight total."""
    total = sum(weights.values())
    reached, out = 0.0, None
    for choice, weight in weights.items():
        reached += weight
        hit = unit * F.lit(float(total)) <= F.lit(float(reached))
        out = F.when(hit, F.lit(choice)) if out is None else out.when(hit, F.lit(choice))
    return out

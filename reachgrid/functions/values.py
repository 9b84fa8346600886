"""Column expressions for lenient numbers, clock times, dates, ids and class labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feed specification: weekday columns, Monday first.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Basic route types a router can map, and the extended range.
BASIC_ROUTE_TYPES = (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)
EXTENDED_ROUTE_TYPES = (100, 1499)
# Transit sub-modes in canonical order.
TRANSIT_MODES = ("TRAM", "SUBWAY", "RAIL", "BUS", "FERRY", "CABLE_CAR", "GONDOLA", "FUNICULAR")


def number(c: Column) -> Column:
    """Text or number to double; blank, missing and non-numeric become NULL."""
    return c.try_cast("double")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def comma_number(c: Column) -> Column:
    """Number text with a decimal comma."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def whole(c: Column, dtype: str = "bigint") -> Column:
    return F.round(c).cast(dtype)


def id_key(c: Column) -> Column:
    """Comparable id text: 12, 12.0 and '12' agree; blank and 'NULL' are dropped."""
    text = F.trim(c.cast("string"))
    # A whole number held as double would read 1.2345678E7.
    held = F.when(F.typeof(c).isin("double", "float") & (text.try_cast("double") == F.floor(text.try_cast("double"))), text.try_cast("double").try_cast("bigint").cast("string"))
    text = F.coalesce(held, F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"))
    return F.when(text.isin("", "NULL"), None).otherwise(text)


def numeric_text_key(c: Column) -> Column:
    """Key text of a number stored as number or text: '7.0', 7 and '7' give '7'."""
    return c.try_cast("double").try_cast("bigint").cast("string")


def clock_seconds(c: Column) -> Column:
    """'HH:MM:SS' to seconds; hours may exceed 24. Anything else is NULL."""
    parts = F.split(F.trim(c), ":")
    value = (F.get(parts, F.lit(0)).try_cast("int") * 3600
             + F.get(parts, F.lit(1)).try_cast("int") * 60 + F.get(parts, F.lit(2)).try_cast("int"))
    return F.when(F.size(parts) == 3, value)


def clock_minutes(c: Column) -> Column:
    """'HH:MM…' to minutes of the day."""
    parts = F.split(F.trim(c), ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def scenario_clock(text: str) -> int:
    """'HH:mm' of a scenario to seconds; hours 0..30."""
    found = re.fullmatch(r"\s*(\d+):(\d+)\s*", str(text))
    hours, minutes = (int(found[1]), int(found[2])) if found else (-1, 0)
    if not 0 <= hours <= 30 or minutes > 59:
        raise ValueError(f"not a scenario time: {text!r}")
    return 3600 * hours + 60 * minutes


def feed_date(c: Column) -> Column:
    """'yyyymmdd' to a date; malformed text is NULL."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def weekday_flag(date: Column, flags: Column) -> Column:
    """Flag of the date's weekday in an array ordered Monday to Sunday."""
    return F.get(flags, F.weekday(date))


def route_list(c: Column) -> Column:
    """'86, Z2  14' to ['86','Z2','14']: any of comma, semicolon, blank; order kept."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+"), lambda t: t != ""))


def price_class(c: Column) -> tuple[Column, Column]:
    """(low, high) of a price class label; an open side is NULL."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d  ]*)"), F.lit(1)),
                        lambda t: F.regexp_replace(t, "[  ]", "").cast("bigint"))
    label = F.lower(c)
    open_top = F.contains(c, F.lit("≥")) | F.contains(label, F.lit("powyżej"))
    open_bottom = F.contains(label, F.lit("poniżej"))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    low = F.when(~open_top & open_bottom, None).otherwise(first)
    high = F.when(open_top, None).when(open_bottom, first).otherwise(second)
    return low, high


def route_type_supported(c: Column) -> Column:
    return F.coalesce(c.isin(*BASIC_ROUTE_TYPES) | c.between(*EXTENDED_ROUTE_TYPES), F.lit(False))


def traction(route_type: Column) -> Column:
    """Traction class of a route type given as text; the first matching rule wins."""
    rt = F.coalesce(route_type.cast("string"), F.lit(""))
    # Fixed rules: exact codes, extended prefix, class.
    rules = ((("0", "5"), "90", "tram"), (("1",), "40", "metro"), (("2",), "1", "rail"),
             (("3",), "7", "bus"), (("11",), "80", "trolleybus"), (("4",), "100", "ferry"))
    out = None
    for codes, prefix, label in rules:
        hit = rt.isin(*codes) | rt.startswith(prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def base_speed(maxspeed: Column, default: Column) -> Column:
    """km/h from a speed tag ('50', '30 mph'), kept only within 5..140, else the class default."""
    digits = F.regexp_extract(F.coalesce(maxspeed, F.lit("")), r"^\s*(\d+)\s*(mph)?\s*$", 1)
    unit = F.regexp_extract(F.coalesce(maxspeed, F.lit("")), r"^\s*(\d+)\s*(mph)?\s*$", 2)
    kmh = digits.try_cast("double") * F.when(unit == "mph", 1.609).otherwise(1.0)
    return F.when(kmh.between(5, 140), kmh).otherwise(default)


def one_hot(c: Column, categories: Sequence[str], prefix: str = "") -> list[Column]:
    """0/1 column per category plus a constant ``total``."""
    return [F.coalesce((c == k).cast("int"), F.lit(0)).alias(prefix + k) for k in categories] + [
        F.lit(1).alias(prefix + "total")]


def submodes(chosen: Column | None, has_transit: Column) -> Column:
    """Label of the transit sub-modes in use: 'N/A' without transit, 'ALL' when none was chosen."""
    known = F.array(*[F.lit(m) for m in TRANSIT_MODES])
    picked = F.array_intersect(known, F.coalesce(chosen, F.array().cast("array<string>")))
    return (F.when(~has_transit, "N/A").when(F.size(picked) == 0, "ALL")
            .otherwise(F.array_join(picked, ",")))


def park_points(area_ha: Column) -> Column:
    """Entrance points sampled on a large park's border, 4..12 growing with sqrt(area)."""
    return F.least(F.lit(12), F.greatest(F.lit(4), F.bround(F.sqrt(area_ha) / 3).cast("int")))


def parse_percentiles(text: str | Iterable[int]) -> list[int]:
    """One to five percentiles, 1..99, strictly ascending."""
    tokens = re.split(r"[,;\s]+", text.strip()) if isinstance(text, str) else list(text)
    values = [int(t) for t in tokens if str(t) != ""]
    ascending = all(a < b for a, b in zip(values, values[1:]))
    if not 1 <= len(values) <= 5 or not ascending or values[0] < 1 or values[-1] > 99:
        raise ValueError("percentiles must be 1 to 5 ascending whole numbers from 1 to 99")
    return values


def check_cutoffs(cutoffs: Iterable[int], *, service_minutes: bool = False) -> list[int]:
    """Sorted distinct positive cutoffs; service minutes are defined up to minute 119."""
    values = sorted({int(c) for c in cutoffs})
    if not values or values[0] < 1 or (service_minutes and values[-1] > 119):
        raise ValueError(f"bad cutoffs: {values}")
    return values


def trip_cap(max_trip: int, cutoffs: Iterable[int]) -> int:
    """The trip budget, raised to the largest cutoff."""
    return max([max_trip, *cutoffs])


def require_columns(df, names: Iterable[str], label: str) -> None:
    """A missing requested column is an error, never a silent zero."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label}: missing column(s) {', '.join(missing)}")


def require_new_columns(df, names: Iterable[str], label: str) -> None:
    clash = sorted(set(names) & set(df.columns))
    if clash:
        raise ValueError(f"{label}: column(s) already present: {', '.join(clash)}")

"""Calendar columns of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(d: Column) -> Column:
    """ISO year times 100 plus week."""
    return F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)


def calendar_fields(d: Column) -> dict[str, Column]:
    """Monday is day 0; month and quarter ends are calendar ends."""
    end = d == F.last_day(d)
    return {
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "day_of_year": F.dayofyear(d),
        "quarter": F.quarter(d),
        "is_month_end": end.cast("int"),
        "is_quarter_end": (end & (F.month(d) % 3 == 0)).cast("int"),
    }


def _on(d: Column, month: int, day: int) -> Column:
    return F.make_date(F.year(d), F.lit(month), F.lit(day))


def _weekday_of(d: Column, month: int, day: int, name: str) -> Column:
    """The first such weekday from a day of d's year on."""
    return F.next_day(F.date_sub(_on(d, month, day), 1), name)


def seasonal_flags(d: Column) -> dict[str, Column]:
    """driving_season: last Monday of May to first Monday of September; heating_season: October to March."""
    driving = (d >= _weekday_of(d, 5, 25, "MON")) & (d <= _weekday_of(d, 9, 1, "MON"))
    return {"driving_season": driving.cast("int"), "heating_season": F.month(d).isin(10, 11, 12, 1, 2, 3).cast("int"), "us_holiday": us_holiday(d).cast("int")}


#: Federal holidays with a date (month, day, first year) and by weekday (month, earliest day, weekday, first year).
DATED = ((1, 1, 1870), (6, 19, 2021), (7, 4, 1870), (11, 11, 1938), (12, 25, 1870))
FLOATING = ((1, 15, "MON", 1986), (2, 15, "MON", 1971), (5, 25, "MON", 1971), (9, 1, "MON", 1894), (10, 8, "MON", 1971), (11, 22, "THU", 1942))


def us_holiday(d: Column) -> Column:
    """Whether d is a US federal holiday, or the weekday on which one that falls on a weekend is observed."""
    out = F.lit(False)
    for month, day, since in DATED:
        out |= (d == _on(d, month, day)) & (F.year(d) >= since)
        sunday, saturday = F.date_sub(d, 1), F.date_add(d, 1)
        out |= (F.weekday(sunday) == 6) & (sunday == _on(sunday, month, day)) & (F.year(sunday) >= since)
        out |= (F.weekday(saturday) == 5) & (saturday == _on(saturday, month, day)) & (F.year(saturday) >= since)
    for month, day, name, since in FLOATING:
        out |= (d == _weekday_of(d, month, day, name)) & (F.year(d) >= since)
    return out


def next_business_day(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))

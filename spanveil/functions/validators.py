"""Checks on a matched string, as column expressions.

Each takes the match and returns a boolean column.  They are looked up by name
from a rule row, so a rule table stays plain data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    return F.call_function("luhn_check", _digits(match))


def ssn(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


def iban(match: Column) -> Column:
    """ISO 7064 mod 97: country and check digits move to the end, letters count from 10."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
        return ((acc * F.when(value > 9, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def aba(match: Column) -> Column:
    """Routing number: weights 3, 7, 1 over nine digits, total divisible by ten."""
    total = F.lit(0)
    for place in range(9):
        digit = F.substring(match, place + 1, 1).cast("int")
        total = total + digit * (3, 7, 1)[place % 3]
    return total % 10 == 0


def calendar_date(match: Column) -> Column:
    """The leading date exists in the calendar: year first, or month/day/year."""
    iso = F.try_to_date(F.substring(match, 1, 10), "yyyy-MM-dd")
    us = F.try_to_date(match, "M/d/yyyy")
    return F.coalesce(F.when(match.contains("/"), us).otherwise(iso).isNotNull(), F.lit(False))


def url_host(match: Column) -> Column:
    return F.coalesce(F.try_parse_url(match, F.lit("HOST")).isNotNull(), F.lit(False))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "ssn": ssn,
    "iban": iban,
    "aba": aba,
    "calendar_date": calendar_date,
    "url_host": url_host,
}

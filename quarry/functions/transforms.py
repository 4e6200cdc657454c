"""String transforms as Column functions; null stays null, an empty result stays empty."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEPT = "\ue000"  # stands for the sharp s while a text is made upper case


def trim(c: Column) -> Column:
    """Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    """Character by character: the sharp s has no upper case of one character and stays."""
    return F.translate(F.upper(F.translate(c, "ß", _KEPT)), _KEPT, "ß")


def collapse_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_non_digits(c: Column) -> Column:
    """Keeps digits, dots and minus signs."""
    return F.regexp_replace(c, r"(?U)[^\d.\-]", "")


def strip_currency_symbols(c: Column) -> Column:
    """Keeps digits, dots, commas and minus signs."""
    return trim(F.regexp_replace(c, r"(?U)[^\d.,\-]", ""))


class Transform(Enum):
    TRIM = "Trim"
    LOWERCASE = "Lowercase"
    UPPERCASE = "Uppercase"
    COLLAPSE_WHITESPACE = "CollapseWhitespace"
    STRIP_NON_DIGITS = "StripNonDigits"
    STRIP_CURRENCY_SYMBOLS = "StripCurrencySymbols"


FUNCTIONS: dict[Transform, Callable[[Column], Column]] = {
    Transform.TRIM: trim,
    Transform.LOWERCASE: lowercase,
    Transform.UPPERCASE: uppercase,
    Transform.COLLAPSE_WHITESPACE: collapse_whitespace,
    Transform.STRIP_NON_DIGITS: strip_non_digits,
    Transform.STRIP_CURRENCY_SYMBOLS: strip_currency_symbols,
}


def apply(c: Column, transforms: Iterable[Transform]) -> Column:
    """The transforms in order: one projection."""
    return reduce(lambda x, t: FUNCTIONS[t](x), transforms, c)


def parse_names(names: Iterable[str] | None) -> list[Transform]:
    """Transforms by name, case ignored; unknown names warn and are skipped."""
    known = {t.value.lower(): t for t in Transform}
    out = []
    for n in names or ():
        if n.strip().lower() in known:
            out.append(known[n.strip().lower()])
        else:
            warnings.warn(f"unknown transform {n!r} is ignored", stacklevel=2)
    return out

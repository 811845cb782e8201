"""Sizes and times as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescape.functions.labels import SIZE_UNITS
from filescape.functions.names import _col

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def human_size(size: Column | str) -> Column:
    """Size with one decimal in the largest unit of 1024 that fits it."""
    size = _col(size)
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, prefix in enumerate("KMGTPE", start=1):
        unit = 1024**power
        # tenths from whole numbers: tens of the quotient, half to even on the rest
        exact = size.cast("decimal(38,0)") * 10
        tenths = F.floor(exact / F.lit(unit).cast("decimal(20,0)"))
        rest = exact - tenths * F.lit(unit).cast("decimal(20,0)")
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1))
        tenths = (tenths + F.when(up, 1).otherwise(0)).cast("bigint")
        label = F.format_string(f"%d.%d {prefix}iB", F.floor(tenths / 10), tenths % 10)
        text = F.when(size >= unit, label).otherwise(text)
    return text


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_size(text: Column | str) -> Column:
    """Bytes meant by texts such as 1.5GiB or 512k; null where the text is no size."""
    text = _trimmed(_col(text))
    digits = F.regexp_extract(text, r"^[0-9.]+", 0)
    unit = F.upper(_trimmed(F.regexp_replace(text, r"^[0-9.]+", "")))
    table = [F.lit(part) for name, factor in SIZE_UNITS.items() for part in (name, float(factor))]
    factor = F.try_element_at(F.create_map(*table), unit)
    number = F.when(digits.rlike("[0-9]"), digits).try_cast("double")
    return F.floor(number * factor).try_cast("bigint")


def size_in_bytes(text: str | int) -> int:
    """`parse_size` for a parameter; raises ValueError where the text is no size."""
    if isinstance(text, int):
        return text
    match = re.fullmatch(r"([0-9.]+)(.*)", text.strip(), re.DOTALL)
    if not match:
        raise ValueError(f"invalid size {text!r}")
    unit = match[2].strip().upper()
    if unit not in SIZE_UNITS:
        raise ValueError(f"invalid size {text!r}: unknown unit {unit!r}")
    try:
        return int(float(match[1]) * SIZE_UNITS[unit])
    except ValueError:
        raise ValueError(f"invalid size {text!r}: bad number") from None


def modified_time(text: Column | str) -> Column:
    """RFC 3339 timestamp; null for any other text."""
    text = _col(text)
    return F.when(
        text.rlike(_RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit(".")))
    )

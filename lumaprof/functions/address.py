"""Address arithmetic on 64-bit addresses held in signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_MASK = 0x00FF_FFFF_FFFF_FFFF


def untagged(ip: Column) -> Column:
    """Drop the top-byte tag."""
    return ip.bitwiseAND(F.lit(TAG_MASK))


def relative(ip: Column, start: Column, end: Column, load_bias: Column, offset: Column) -> Column:
    """Module-relative address, or null outside the mapping or below zero."""
    shifted = F.when(load_bias != 0, ip - load_bias).otherwise(ip - start + offset)
    return F.when((ip >= start) & (ip < end) & (shifted >= 0), shifted)


def hex_text(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def frame_label(module: Column, function: Column, relative_address: Column) -> Column:
    """``function (module)``, or ``module+0xaddr`` when the name is unknown."""
    named = F.concat(function, F.lit(" ("), module, F.lit(")"))
    bare = F.concat(module, F.lit("+"), hex_text(relative_address))
    return F.when(F.coalesce(function, F.lit("")) == "", bare).otherwise(named)

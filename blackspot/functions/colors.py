"""Colour expressions for map layers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
COLOR_STEPS = 256
GREEN_LEVEL = 128
PALETTE_SIZE = 10


def green_red_hex(value: Column) -> Column:
    """``#rrggbb`` on a 256-step ramp from green (0) to red (1); NULL stays NULL."""
    step = F.least(F.floor(value * COLOR_STEPS), F.lit(COLOR_STEPS - 1).cast("bigint"))
    red = step
    green = F.round(F.lit(float(GREEN_LEVEL)) * (F.lit(1.0) - step / F.lit(float(COLOR_STEPS - 1)))).cast("bigint")
    two = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return F.when(value.isNotNull(), F.concat(F.lit("#"), two(red), two(green), F.lit("00")))

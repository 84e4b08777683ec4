"""Run-name expression: ``<direction>_<size>_<epochs>_run-YYYYmmdd-HHMMSS``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_name(direction, size, epochs, ts) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in (direction, size, epochs)]
    stamp = F.concat(F.lit("run-"), F.date_format(_c(ts), "yyyyMMdd-HHmmss"))
    return F.concat_ws("_", *[p.cast("string") for p in parts], stamp)

"""Per-entity bar windows with full-window semantics.

A rolling value is null until its frame holds `bars` observed values. One entity holds at most
one row per session, so the rows of a window partition are bounded by the calendar, however
many raw records the entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_bar(entity: str = "ticker", clock: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(clock)


def full_window(agg, value: Column, bars: int, w: WindowSpec, minimum: int | None = None, skip: int = 0) -> Column:
    """`agg(value)` over the last `bars` rows (ending `skip` rows back), null before it is full."""
    frame = w.rowsBetween(-(bars - 1) - skip, -skip)
    needed = bars if minimum is None else minimum
    return F.when(F.count(value).over(frame) >= needed, agg(value).over(frame))


def change(value: Column, bars: int, w: WindowSpec) -> Column:
    """Relative change over `bars` rows."""
    return F.try_divide(value, F.lag(value, bars).over(w)) - 1.0


def same_regime(marker: Column | None, lag_from: int, lag_to: int, w: WindowSpec) -> Column:
    """True when a marker (such as a distribution number) is equal at two bars; true without one."""
    if marker is None:
        return F.lit(True)
    here = marker if lag_from == 0 else F.lag(marker, lag_from).over(w)
    return here == F.lag(marker, lag_to).over(w)


def compounded(value: Column, frame: WindowSpec | None = None) -> Column:
    growth = F.product(1.0 + value)
    return (growth.over(frame) if frame is not None else growth) - 1.0

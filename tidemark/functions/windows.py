"""Window expressions: guarded rolling frames, tie-averaged ranks, order statistics by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


class Panel:
    """Windows of one entity's rows in session order. All share one partitioning, so a plan of them shuffles once."""

    def __init__(self, by: str = "ticker", order: str = "idx"):
        self.by, self.order = by, order

    @property
    def ordered(self):
        return Window.partitionBy(self.by).orderBy(self.order)

    def lag(self, c: Column | str, n: int) -> Column:
        return F.lag(c, n).over(self.ordered)

    def lead(self, c: Column | str, n: int) -> Column:
        return F.lead(c, n).over(self.ordered)

    def roll(self, agg: Callable[[Column], Column], c: Column, n: int, last: int = 0) -> Column:
        """The aggregate of ``n`` rows up to ``last`` rows back; null unless all ``n`` hold a value."""
        frame = self.ordered.rowsBetween(-(n - 1) - last, -last)
        return F.when(F.count(c).over(frame) == n, agg(c).over(frame))

    def some(self, agg: Callable[[Column], Column], c: Column, n: int, last: int = 0) -> Column:
        """The same over the values that there are."""
        return agg(c).over(self.ordered.rowsBetween(-(n - 1) - last, -last))


class Rolls:
    """Rolling aggregates of named columns, each computed once however many expressions use it.

    ``get`` notes what is needed and gives the guarded value; ``add`` puts all noted windows on a table in one stage."""

    AGGS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}

    def __init__(self, panel: Panel):
        self.panel, self.noted = panel, {}

    def _note(self, agg: str, column: str, n: int) -> Column:
        self.noted[f"_{agg}_{column}_{n}"] = (agg, column, n)
        return F.col(f"_{agg}_{column}_{n}")

    def get(self, agg: str, column: str, n: int) -> Column:
        return F.when(self._note("count", column, n) == n, self._note(agg, column, n))

    def add(self, df):
        frames = {n: self.panel.ordered.rowsBetween(-(n - 1), 0) for _, _, n in self.noted.values()}
        made = [(F.count(c) if a == "count" else self.AGGS[a](c)).over(frames[n]).alias(name) for name, (a, c, n) in self.noted.items()]
        return df.select("*", *made)


def average_rank(c: Column, by: Sequence[str]) -> Column:
    """Ascending rank within the group, ties averaged."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (ties - 1) / F.lit(2.0)


def percentile_rank(c: Column, by: Sequence[str]) -> Column:
    """Average rank scaled to -1..1; 0 in a group of one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n > 1, 2.0 * (average_rank(c, by) - 1.0) / (n - 1.0) - 1.0).otherwise(0.0)


def observed_percentile_rank(c: Column, by: Sequence[str]) -> Column:
    """Percentile rank among the values that there are; 0 for a null and in a group with one value."""
    w = Window.partitionBy(*by)
    n = F.count(c).over(w)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    rank = F.rank().over(w.orderBy(c.asc_nulls_last())) + (ties - 1) / F.lit(2.0)
    return F.when(c.isNull() | (n <= 1), F.lit(0.0)).otherwise(2.0 * (rank - 1.0) / (n - 1.0) - 1.0)


def place(by: Sequence[str], *order: Column) -> Column:
    """Ordinal position within the group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")


def ceil_share(n: Column, share: float) -> Column:
    """ceil(n * share), at least one: the place of a nearest-rank quantile, or the size of a tail."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("long")

"""Window expressions on a daily series: lags, rolling statistics, fills, islands, ages.

Each function returns a Column over a window specification the caller owns, so a whole stack of them shares one
exchange and one sort. The series must hold one row per key and date, which bounds a window group by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(order or ("date",)))


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def until_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def reversed_until_now(keys: Sequence[str], date: str = "date") -> WindowSpec:
    """Rows from the current one to the end, as a running frame over descending dates: linear, where a frame up to
    unbounded following is evaluated anew for every row."""
    return until_now(Window.partitionBy(*keys).orderBy(F.col(date).desc()))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rolling_mean(c, w: WindowSpec, rows: int, min_rows: int | None = None) -> Column:
    """Mean of the last ``rows`` rows, null while fewer than ``min_rows`` values are present."""
    frame, need = trailing(w, rows), rows if min_rows is None else min_rows
    return F.when(F.count(c).over(frame) >= need, F.avg(c).over(frame))


def rolling_std(c, w: WindowSpec, rows: int, min_rows: int | None = None) -> Column:
    frame, need = trailing(w, rows), rows if min_rows is None else min_rows
    return F.when(F.count(c).over(frame) >= need, F.stddev_samp(c).over(frame))


def centred_mean(c, w: WindowSpec, rows: int) -> Column:
    """Centred mean; an even window has its extra row before the centre."""
    frame = w.rowsBetween(-(rows // 2), rows - 1 - rows // 2)
    return F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame))


def band_width(c, w: WindowSpec, rows: int = 20) -> Column:
    """Width of mean ± 2 sample deviations over the mean; null for a zero mean and for the first row."""
    frame = trailing(w, rows)
    return 4 * F.stddev_samp(c).over(frame) / F.nullif(F.avg(c).over(frame), F.lit(0.0))


def forward_fill(c, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(until_now(w))


def next_known(c, keys: Sequence[str], date: str = "date") -> Column:
    return F.last(c, ignorenulls=True).over(reversed_until_now(keys, date))


def interpolated(c, keys: Sequence[str], both: bool = False, places: int | None = 1, date: str = "date") -> Column:
    """Linear by row position; trailing nulls take the last value, leading ones stay null unless ``both``."""
    w = ordered(keys, date)
    c, pos = _col(c), F.row_number().over(w)
    known = F.when(c.isNotNull(), F.struct(pos.alias("i"), c.alias("v")))
    prev, nxt = forward_fill(known, w), next_known(known, keys, date)
    inner = prev["v"] + (nxt["v"] - prev["v"]) * (pos - prev["i"]) / (nxt["i"] - prev["i"])
    out = F.when(c.isNotNull(), c).when(prev.isNotNull() & nxt.isNotNull(), inner).when(prev.isNotNull(), prev["v"])
    if both:
        out = out.otherwise(nxt["v"])
    return out if places is None else F.bround(out, places)


def changed(c, w: WindowSpec) -> Column:
    """Value differs from the row before; a null on either side counts as a change."""
    c = _col(c)
    return ~F.coalesce(c == F.lag(c).over(w), F.lit(False))


def data_age(df: DataFrame, column: str, keys: Sequence[str], out: str = "age") -> DataFrame:
    """Rows since the value last changed: 0 at a change, then 1, 2, …"""
    w = ordered(keys)
    return (
        df.withColumn("_change", changed(column, w).cast("int"))
        .withColumn("_island", F.sum("_change").over(until_now(w)))
        .withColumn(out, F.row_number().over(ordered([*keys, "_island"])) - 1)
        .drop("_change", "_island"))


def log_return(c, w: WindowSpec) -> Column:
    c = _col(c)
    return F.ln(c / F.lag(c).over(w))


def percent_change(c, w: WindowSpec, rows: int = 1) -> Column:
    """Change over ``rows`` rows of a series without nulls; forward fill first where it has some."""
    c = _col(c)
    return c / F.lag(c, rows).over(w) - 1


def gain_loss(c, w: WindowSpec) -> tuple[Column, Column]:
    """Positive and negative part of the first difference; the first row keeps its null."""
    c = _col(c)
    d = c - F.lag(c).over(w)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))


def lagged(c, w: WindowSpec, default=0) -> Column:
    return F.coalesce(F.lag(c).over(w), F.lit(default))


def day_gap(df: DataFrame, keys: Sequence[str], open_col: str = "is_open") -> DataFrame:
    """Days since the previous open day, 0 on closed days and on the first open day, with weekend/holiday flags."""
    previous = F.max(F.when(F.col(open_col), F.col("date"))).over(
        ordered(keys).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col(open_col), F.coalesce(F.datediff("date", previous), F.lit(0))).otherwise(0)
    return (
        df.withColumn("gap_days", gap)
        .withColumn("post_weekend", F.col("gap_days") == 3)
        .withColumn("post_holiday", F.col("gap_days") > 3))


def cyclic(date="date") -> dict[str, Column]:
    """Sine and cosine of weekday (Monday = 0) over 7 and month (January = 0) over 12."""
    d, m = 2 * F.pi() * F.weekday(date) / 7, 2 * F.pi() * (F.month(date) - 1) / 12
    return {"dow_sin": F.sin(d), "dow_cos": F.cos(d), "month_sin": F.sin(m), "month_cos": F.cos(m)}


def date_spine(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Every calendar day between the first and last date of each key, with the values where they exist.

    Each row spans the days up to the next row of its key, so the expansion needs no join back.
    """
    last = F.coalesce(F.date_sub(F.lead(date).over(ordered(keys, date)), 1), F.col(date))
    values = [c for c in df.columns if c not in keys and c != date]
    return (
        df.withColumn("_last", last)
        .select(*keys, *values, F.posexplode(F.sequence(date, "_last")).alias("_nth", date))
        .select(*keys, date, *[F.when(F.col("_nth") == 0, F.col(v)).alias(v) for v in values]))


def maturity_cut(df: DataFrame, keys: Sequence[str], flag: str, rows: int = 60, share: float = 0.5) -> DataFrame:
    """Rows from the first date on which the share of ``flag`` over ``rows`` full rows reaches ``share``."""
    w = ordered(keys)
    freq = rolling_mean(F.col(flag).cast("double"), w, rows)
    return (
        df.withColumn("trade_frequency", freq)
        .withColumn("_start", F.min(F.when(F.col("trade_frequency") >= share, F.col("date"))).over(Window.partitionBy(*keys)))
        .filter(F.col("date") >= F.col("_start")).drop("_start"))


def cross_signal(c, w: WindowSpec, rows: int = 20) -> Column:
    """1 where the value exceeds its full-window mean, else 0."""
    return F.when(_col(c) > rolling_mean(c, w, rows), 1).otherwise(0)


def threshold_signal(rsi, w: WindowSpec, low: float = 30.0, high: float = 70.0) -> Column:
    """1 below ``low``, 0 above ``high``, else the last of the two, 0 before the first."""
    rsi = _col(rsi)
    return F.coalesce(forward_fill(F.when(rsi < low, 1).when(rsi > high, 0), w), F.lit(0))

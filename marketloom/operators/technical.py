"""The daily feature panel: technical, calendar and age columns of all markets in one window stack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from marketloom.operators import decay, series
from marketloom.operators.series import ordered


def technical_features(df: DataFrame, keys: Sequence[str] = ("market",), close: str = "close", volume: str = "volume") -> DataFrame:
    """Returns, band width, strength index, volume mean and cyclic time columns."""
    w = ordered(keys)
    gain, loss = series.gain_loss(close, w)
    base = df.withColumns({
        "log_return": series.log_return(close, w), "return_5d": series.percent_change(close, w, 5),
        "bb_width": series.band_width(close, w), "volume_sma_20": series.rolling_mean(volume, w, 20, 1),
        "gain_part": gain, "loss_part": loss})
    smooth = decay.ewm_mean(base, keys, {"gain": "gain_part", "loss": "loss_part"}, 1 / 14, 14)
    return (
        smooth.withColumn("rsi_14", decay.relative_strength("gain", "loss"))
        .drop("gain", "loss", "gain_part", "loss_part").withColumns(series.cyclic()))


def with_ages(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("market",)) -> DataFrame:
    """Rows since each column last changed, as ``<column>_age``; all columns share the exchange by key."""
    for c in columns:
        df = series.data_age(df, c, keys, f"{c}_age")
    return df

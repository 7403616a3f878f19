"""Indicator series in long form: frequency, publication lag, names, and the one-pass wide join."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators import series
from marketloom.operators.series import ordered

# Translations of the pieces of an indicator's file name.
PIECES = {
    "中国": "China",
    "湖北": "Hubei",
    "广东": "Guangdong",
    "用电量": "ElectricityConsumption",
    "工业增加值": "IndustrialAddedValue",
    "可比价": "RealPrices",
    "规模以上工业企业": "AboveScaleIndustry",
    "全社会用电量": "TotalElectricityConsumption",
    "发电量": "ElectricityGeneration",
    "GDP": "GDP",
    "累计值": "Cumulative",
    "当月值": "Monthly",
    "当月同比": "YoY",
    "产量": "Output",
    "粗钢": "CrudeSteel",
    "原油加工量": "CrudeOilProcessing",
    "原煤": "RawCoal",
    "水泥": "Cement",
    "社会融资规模": "TotalSocialFinancing",
    "火电": "ThermalPower",
    "制造业PMI": "ManufacturingPMI",
    "CPI": "CPI",
    "CFETS": "CFETS",
    "即期汇率": "SpotFX",
    "美元兑人民币": "USD_CNY",
    "欧洲ARA港": "ARA_Europe",
    "现价": "CurrentPrices",
    "动力煤": "ThermalCoal",
    "现货价": "SpotPrice",
    "期货收盘价(连续)": "FuturesClose(Cont)",
    "期货结算价(连续)": "FuturesSettle(Cont)",
    "NYMEX天然气": "NYMEX_NatGas",
    "欧盟排放配额(EUA)": "EUA_Futures",
    "布伦特原油": "BrentCrude",
}

# Region folder by the first piece of the name.
REGIONS = {"湖北": "hubei", "广东": "guangdong"}
OTHER_REGION = "national_or_global"

# Publication lag in rows by detected frequency.
LAGS = {"D": 1, "M": 15, "Q": 15}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def english_name(name: Column) -> Column:
    """Translate a name piece by piece; unknown pieces stay."""
    table = _literal_map(PIECES)
    return F.array_join(F.transform(F.split(name, "_"), lambda x: F.coalesce(F.try_element_at(table, x), x)), "_")


def region_of(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(REGIONS), F.split(name, "_")[0]), F.lit(OTHER_REGION))


def reported_frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frequency from the median gap of the raw dates. Gaps are whole days, so the exact median keeps few values."""
    gap = F.datediff("date", F.lag("date").over(ordered(keys)))
    m = F.floor("median_gap")
    label = (
        F.when((m > 27) & (m < 32), "M").when((m > 85) & (m < 95), "Q").when(m == 1, "D")
        .otherwise(F.concat(F.lit("Other_"), m.cast("string"))))
    return (
        df.select(*keys, gap.alias("gap")).groupBy(*keys)
        .agg(F.percentile("gap", F.lit(0.5)).alias("median_gap")).withColumn("frequency", label))


def detected_frequency(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Frequency from the median gap between value changes of a daily series, with the publication lag."""
    w = ordered(keys)
    points = df.withColumn("_c", series.changed(value, w)).filter("_c")
    gap = F.datediff("date", F.lag("date").over(w))
    m = F.col("median_gap")
    label = (
        F.when(m <= 1.5, "D").when(m.between(25, 35), "M").when(m.between(80, 100), "Q").otherwise("unknown"))
    lag = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for x in chain.from_iterable(LAGS.items())]), F.col("frequency")), F.lit(1))
    return (
        points.select(*keys, gap.alias("gap")).groupBy(*keys)
        .agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
        .withColumn("frequency", label).withColumn("lag_rows", lag))


def shifted(df: DataFrame, keys: Sequence[str], lags: DataFrame, value: str = "value") -> DataFrame:
    """Each series lagged by its own number of rows, whatever it is: rows meet the row that many places before by an equi-join.

    A null lag gives null values.
    """
    keys = list(keys)
    rows = df.join(lags.select(*keys, "lag_rows"), keys).withColumn("_nth", F.row_number().over(ordered(keys)))
    earlier = rows.select(*keys, (F.col("_nth") + F.col("lag_rows")).alias("_nth"), F.col(value).alias("_earlier"))
    out = rows.join(earlier, [*keys, "_nth"], "left").withColumn(value, F.col("_earlier")).drop("_nth", "_earlier")
    return out.withColumn("name", F.concat_ws("_", *keys, "lag_rows"))


def wide(df: DataFrame, names: Sequence[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """Long indicators to one column per name and one row per date."""
    return df.groupBy("date").pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def join_wide(panel: DataFrame, indicators: DataFrame, names: Sequence[str], name: str = "indicator") -> DataFrame:
    """Panel with all indicators by date: one pivot and one join instead of a join per indicator.

    Columns the panel already has are kept from the panel.
    """
    new = [n for n in names if n not in panel.columns]
    return panel.join(wide(indicators, new, name), "date", "left")

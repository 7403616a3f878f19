"""Cleaning, flags, audits and indicator queries."""

from pyspark.sql import functions as F

from marketloom.operators import cleaning, indicators, series
from marketloom.operators.series import ordered
from marketloom.queries.features import SPINE, daily_indicator
from marketloom.queries.registry import query

M = ["market"]


@query("P01_type_coercion", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
       TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders
""")
def _(t):
    text = t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"), F.col("o_orderpriority").alias("bad"))
    return cleaning.coerce(text, ["level", "bad"], {"day": "yyyy/MM/dd"})


@query("P02_date_range", "SELECT * FROM ind WHERE date BETWEEN DATE '1996-02-01' AND DATE '1998-03-31'", ("ind",))
def _(t):
    return cleaning.between_dates(t.ind, "1996-02-01", "1998-03-31")


@query("P03_maturity_cut", """
WITH f AS (SELECT market, date, has_trade, CASE WHEN count(*) OVER w >= 60 THEN avg(CAST(CAST(has_trade AS INTEGER) AS DOUBLE)) OVER w END AS f
           FROM panel WINDOW w AS (PARTITION BY market ORDER BY date ROWS 59 PRECEDING))
SELECT market, date, has_trade, R6(f) AS trade_frequency FROM f
WHERE date >= (SELECT min(date) FROM f g WHERE g.market = f.market AND g.f >= 0.5)
""", ("panel",))
def _(t):
    cut = series.maturity_cut(t.panel, M, "has_trade", 60, 0.5)
    return cut.select("market", "date", "has_trade", F.round("trade_frequency", 6).alias("trade_frequency"))


@query("P04_activity_flags", """
WITH b AS (SELECT market, min(date) AS lo, max(date) AS hi FROM px GROUP BY market)
SELECT p.market, p.date, p.is_open, p.has_trade, p.is_quiet FROM panel p JOIN b ON b.market = p.market AND p.date BETWEEN lo AND hi
""", ("panel",))
def _(t):
    t.share_px()
    days = series.date_spine(t.px, M)
    flagged = cleaning.activity_flags(days, t.cal.filter("is_open"))
    return flagged.select("market", "date", "is_open", "has_trade", "is_quiet")


@query("P05_split_by_flag", "SELECT market, date, CASE WHEN is_open THEN 'open' ELSE 'closed' END AS part FROM panel", ("panel",))
def _(t):
    opened, closed = cleaning.split_by(t.panel.select("market", "date", "is_open"), "is_open")
    return cleaning.union_all([opened.withColumn("part", F.lit("open")), closed.withColumn("part", F.lit("closed"))]).drop("is_open")


@query("P06_zero_fill", "SELECT market, date, coalesce(vwap, 0) AS vwap, coalesce(close, 0) AS close FROM panel", ("panel",))
def _(t):
    return cleaning.zero_fill(t.panel.select("market", "date", "vwap", "close"), ["vwap", "close"])


@query("P07_gap_flags", """
WITH g AS (SELECT market, date, CASE WHEN is_open THEN coalesce(date_diff('day', max(CASE WHEN is_open THEN date END) OVER
        (PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date), 0) ELSE 0 END AS gap FROM panel)
SELECT market, date, gap = 3 AS post_weekend, gap > 3 AS post_holiday FROM g
""", ("panel",))
def _(t):
    return series.day_gap(t.panel, M).select("market", "date", "post_weekend", "post_holiday")


@query("P08_drop_columns", "SELECT market, date, close FROM px", ("px",))
def _(t):
    return t.px.drop("vwap", "volume", "turnover", "absent_column")


@query("P09_columns_by_schema", "SELECT close, vwap, volume, turnover, close AS close_1 FROM px", ("px",))
def _(t):
    df = t.px.withColumn("close_1", F.col("close"))
    names = [c for c in cleaning.columns_except(df, ["market", "date"]) if c in cleaning.numeric_columns(df)]
    return df.select(*sorted(set(names) | set(cleaning.columns_ending(df, "_1"))))


@query("P10_drop_null_rows", "SELECT market, date, close, vwap FROM panel WHERE close IS NOT NULL AND vwap IS NOT NULL", ("panel",))
def _(t):
    return t.panel.select("market", "date", "close", "vwap").dropna(how="any")


@query("P21_indicator_names", """
WITH n AS (SELECT n_nationkey, concat_ws('_', CASE n_nationkey % 3 WHEN 0 THEN '湖北' WHEN 1 THEN '广东' ELSE replace(n_name, '_', '-') END,
             CASE n_nationkey % 4 WHEN 0 THEN '用电量' WHEN 1 THEN '水泥' WHEN 2 THEN 'GDP' ELSE 'unknown' END, '当月值') AS name FROM nation)
SELECT n_nationkey, name, concat_ws('_', CASE split_part(name, '_', 1) WHEN '湖北' THEN 'Hubei' WHEN '广东' THEN 'Guangdong' ELSE split_part(name, '_', 1) END,
         CASE split_part(name, '_', 2) WHEN '用电量' THEN 'ElectricityConsumption' WHEN '水泥' THEN 'Cement' ELSE split_part(name, '_', 2) END, 'Monthly') AS english,
       CASE split_part(name, '_', 1) WHEN '湖北' THEN 'hubei' WHEN '广东' THEN 'guangdong' ELSE 'national_or_global' END AS region FROM n
""")
def _(t):
    k = F.col("n_nationkey")
    name = F.concat_ws(
        "_", F.when(k % 3 == 0, "湖北").when(k % 3 == 1, "广东").otherwise(F.replace("n_name", F.lit("_"), F.lit("-"))),
        F.when(k % 4 == 0, "用电量").when(k % 4 == 1, "水泥").when(k % 4 == 2, "GDP").otherwise("unknown"), F.lit("当月值"))
    return t.nation.select("n_nationkey", name.alias("name")).select(
        "n_nationkey", "name", indicators.english_name(F.col("name")).alias("english"), indicators.region_of(F.col("name")).alias("region"))


NAMES = ["M_A", "M_N", "M_R", "Q_F", "Q_O", "D_ALL"]


@query("P22_lag_suffix", """
WITH d AS (SELECT indicator, date, lag(value) OVER (PARTITION BY indicator ORDER BY date) AS value FROM ind)
SELECT date, """ + ", ".join(f"max(CASE WHEN indicator = '{n}' THEN value END) AS \"{n}_1\"" for n in NAMES) + """ FROM d GROUP BY date
""", ("ind",))
def _(t):
    lagged = t.ind.withColumn("value", F.lag("value", 1).over(ordered(["indicator"])))
    return indicators.wide(lagged, NAMES).withColumnsRenamed({n: f"{n}_1" for n in NAMES})


@query("J02_indicator_join", SPINE + """
SELECT p.market, p.date, p.close, """ + ", ".join(
    f"max(CASE WHEN f.indicator = '{n}' THEN f.daily END) AS \"{n}\"" for n in NAMES) + """
FROM px p LEFT JOIN filled f ON f.date = p.date GROUP BY p.market, p.date, p.close
""", ("px", "ind"))
def _(t):
    daily = daily_indicator(t).select("indicator", "date", F.col("daily").alias("value"))
    return indicators.join_wide(t.px.select("market", "date", "close"), daily, NAMES)


@query("A01_null_audit", """
WITH a AS (SELECT count(*) AS n FROM panel)
SELECT a.n AS n_rows, c AS "column", nulls, zeros, R6(100.0 * nulls / a.n) AS null_pct FROM a, (
  SELECT 'close' AS c, count_if(close IS NULL)::BIGINT AS nulls, count_if(close = 0)::BIGINT AS zeros FROM panel
  UNION ALL SELECT 'vwap', count_if(vwap IS NULL)::BIGINT, count_if(vwap = 0)::BIGINT FROM panel
  UNION ALL SELECT 'volume', count_if(volume IS NULL)::BIGINT, count_if(volume = 0)::BIGINT FROM panel
  UNION ALL SELECT 'is_open', count_if(is_open IS NULL)::BIGINT, 0 FROM panel)
""", ("panel",))
def _(t):
    a = cleaning.null_audit(t.panel, ["close", "vwap", "volume", "is_open"])
    return a.withColumn("null_pct", F.round("null_pct", 6))


@query("A02_calendar_audit", """
SELECT market, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) + 1 AS expected_days,
       date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_days, count(*) - count(DISTINCT date) AS duplicate_dates
FROM (SELECT r_name AS market, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY market
""")
def _(t):
    per_customer = t.orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    owners = (
        t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", F.col("r_name").alias("market")))
    rows = per_customer.join(owners, F.col("c_custkey") == F.col("o_custkey"))
    return cleaning.calendar_audit(rows, M, rows=F.col("n"))


@query("A03_conditional_share", """
SELECT market, is_open, count(*) AS n_rows, R6(100 * avg(CASE WHEN has_trade THEN 1.0 ELSE 0.0 END)) AS traded_pct,
       R6(100 * avg(CASE WHEN is_quiet THEN 1.0 ELSE 0.0 END)) AS quiet_pct FROM panel GROUP BY market, is_open
""", ("panel",))
def _(t):
    s = cleaning.share_where(t.panel, ["market", "is_open"], traded_pct=F.col("has_trade"), quiet_pct=F.col("is_quiet"))
    return s.withColumns({c: F.round(c, 6) for c in ("traded_pct", "quiet_pct")})


@query("A04_value_counts", """
SELECT source, n, R6(n / sum(n) OVER ()) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def _(t):
    return cleaning.value_counts(t.documents, "source").withColumn("share", F.round("share", 6))


@query("A05_nulls_by_year", """
SELECT market, year(date) AS year, CAST(count_if(close IS NULL) AS BIGINT) AS close_nulls, CAST(count_if(vwap IS NULL) AS BIGINT) AS vwap_nulls
FROM panel GROUP BY market, year(date)
""", ("panel",))
def _(t):
    return cleaning.null_counts_by_year(t.panel, ["close", "vwap"], M)


@query("A06_reported_frequency", """
WITH g AS (SELECT indicator, date_diff('day', lag(date) OVER (PARTITION BY indicator ORDER BY date), date) AS gap FROM ind),
m AS (SELECT indicator, median(gap) AS median_gap FROM g GROUP BY indicator)
SELECT indicator, median_gap, CASE WHEN floor(median_gap) > 27 AND floor(median_gap) < 32 THEN 'M' WHEN floor(median_gap) > 85 AND floor(median_gap) < 95 THEN 'Q'
  WHEN floor(median_gap) = 1 THEN 'D' ELSE concat('Other_', CAST(CAST(floor(median_gap) AS BIGINT) AS VARCHAR)) END AS frequency FROM m
""", ("ind",))
def _(t):
    return indicators.reported_frequency(t.ind, ["indicator"])


@query("A07_detected_frequency", SPINE + """
, c AS (SELECT indicator, date, NOT coalesce(daily = lag(daily) OVER (PARTITION BY indicator ORDER BY date), FALSE) AS ch FROM filled),
g AS (SELECT indicator, date_diff('day', lag(date) OVER (PARTITION BY indicator ORDER BY date), date) AS gap FROM c WHERE ch),
m AS (SELECT indicator, median(gap) AS median_gap FROM g GROUP BY indicator),
f AS (SELECT indicator, median_gap, CASE WHEN median_gap <= 1.5 THEN 'D' WHEN median_gap BETWEEN 25 AND 35 THEN 'M' WHEN median_gap BETWEEN 80 AND 100 THEN 'Q' ELSE 'unknown' END AS frequency FROM m)
SELECT *, CAST(CASE frequency WHEN 'M' THEN 15 WHEN 'Q' THEN 15 ELSE 1 END AS BIGINT) AS lag_rows FROM f
""", ("ind",))
def _(t):
    d = daily_indicator(t).select("indicator", "date", F.col("daily").alias("value"))
    return indicators.detected_frequency(d, ["indicator"]).withColumn("lag_rows", F.col("lag_rows").cast("long"))


@query("J13_date_membership", """
SELECT market, date, date IN (SELECT date FROM ind WHERE indicator LIKE 'M%') AS on_report_date FROM px
""", ("px", "ind"))
def _(t):
    dates = t.ind.filter("indicator LIKE 'M%'").select("date").distinct().withColumn("_hit", F.lit(True))
    return t.px.join(dates, "date", "left").select("market", "date", F.col("_hit").isNotNull().alias("on_report_date"))


@query("T01_sort_by_date", "SELECT market, date, close FROM px", ("px",))
def _(t):
    return t.px.select("market", "date", "close").orderBy("market", "date")


@query("U02_common_dates", """
SELECT date FROM px WHERE market = 'ASIA' INTERSECT SELECT date FROM px WHERE market = 'EUROPE'
""", ("px",))
def _(t):
    t.share_px()
    d = t.px.select("market", "date")
    return d.filter("market = 'ASIA'").select("date").intersect(d.filter("market = 'EUROPE'").select("date"))


@query("U05_distinct_values", "SELECT DISTINCT source FROM documents")
def _(t):
    return t.documents.select("source").distinct()


@query("X02_rolling_apply", """
WITH n AS (SELECT market, date, close, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM px),
p AS (SELECT a.market, a.date, a.i, b.close AS x, max(b.close) OVER (PARTITION BY a.market, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS top, b.i AS bi
      FROM n a JOIN n b ON b.market = a.market AND b.i BETWEEN a.i - 19 AND a.i WHERE a.i >= 20)
SELECT market, date, R6(min(x - top) / max(top)) AS max_dd FROM p GROUP BY market, date
""", ("px",))
def _(t):
    from marketloom.operators import performance

    dd = performance.rolling_drawdown(t.px.select("market", "date", "close"), M, "close", 20)
    return dd.filter("max_dd IS NOT NULL").select("market", "date", F.round("max_dd", 6).alias("max_dd"))

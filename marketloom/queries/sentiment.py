"""Scores, labels, daily sentiment, merges with prices and score statistics."""

from pyspark.sql import functions as F

from marketloom.operators import cleaning, density, sentiment, sketches, statistics
from marketloom.queries.registry import query
from marketloom.session import fresh_path

SOURCES = {"ASIA": ("national", "regional_a"), "EUROPE": ("national", "regional_b")}
DIMS = ["supply", "demand", "strength"]

DOCS = """
docs AS (SELECT doc_id, m.market, publish_date + 1 AS effective_date, source, supply, demand, strength FROM scored
         JOIN (VALUES ('ASIA', 'national'), ('ASIA', 'regional_a'), ('EUROPE', 'national'), ('EUROPE', 'regional_b')) m(market, s) ON m.s = source)
"""
DAILY = "WITH " + DOCS + """,
daily AS (SELECT market, effective_date, sum(supply * (strength + 1)) / sum(strength + 1) AS sentiment_supply,
           sum(demand * (strength + 1)) / sum(strength + 1) AS sentiment_demand, max(strength) AS max_policy, avg(strength) AS avg_policy, count(*) AS doc_count
          FROM docs GROUP BY market, effective_date),
pressed AS (SELECT *, (sentiment_demand - sentiment_supply) * (max_policy / 100) AS market_pressure,
             (abs(sentiment_demand) + abs(sentiment_supply)) * (max_policy / 100) AS pressure_magnitude FROM daily)
"""
DECAY = """
, sums AS (SELECT market, effective_date, sum(supply) AS s, sum(demand) AS d, sum(strength) AS p FROM docs GROUP BY market, effective_date)
"""


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def market_docs(t):
    docs = sentiment.market_rows(t.scored.drop("text"), SOURCES)
    return docs.withColumn("effective_date", F.date_add("publish_date", 1))


@query("P11_market_sources", "WITH " + DOCS + "SELECT doc_id, market, source FROM docs", ("scored",))
def _(t):
    return market_docs(t).select("doc_id", "market", "source")


@query("P14_score_validation", """
SELECT doc_id, supply <= 120 AND demand >= -120 AND doc_id % 7 <> 0 AS valid FROM scored
""", ("scored",))
def _(t):
    text = t.scored.select(
        "doc_id", F.when(F.col("doc_id") % 7 > 0, (F.col("supply") + 30).cast("string")).otherwise("n/a").alias("supply"),
        (F.col("demand") - 30).cast("string").alias("demand"), F.col("strength").cast("string").alias("strength"))
    return text.select("doc_id", sentiment.valid_scores().alias("valid"))


def _ladder(column, bands, last):
    return "CASE " + " ".join(f"WHEN {column} <= {e} THEN '{l}'" for e, l in bands) + f" ELSE '{last}' END"


@query("P17_score_labels", f"""
SELECT doc_id, {_ladder('supply', sentiment.SUPPLY_BANDS, sentiment.SUPPLY_LAST)} AS supply_label, {_ladder('demand', sentiment.DEMAND_BANDS, sentiment.DEMAND_LAST)} AS demand_label,
       {_ladder('strength', sentiment.STRENGTH_BANDS, sentiment.STRENGTH_LAST)} AS strength_label FROM scored
""", ("scored",))
def _(t):
    b = cleaning.bands
    return t.scored.select(
        "doc_id", b(F.col("supply"), sentiment.SUPPLY_BANDS, sentiment.SUPPLY_LAST).alias("supply_label"),
        b(F.col("demand"), sentiment.DEMAND_BANDS, sentiment.DEMAND_LAST).alias("demand_label"),
        b(F.col("strength"), sentiment.STRENGTH_BANDS, sentiment.STRENGTH_LAST).alias("strength_label"))


@query("P18_overall_label", """
SELECT doc_id, concat(CASE WHEN abs(demand - supply) < 25 THEN 'neutral price impact' WHEN demand - supply > 75 THEN 'strong upward price pressure'
   WHEN demand - supply > 25 THEN 'moderate upward price pressure' WHEN demand - supply < -75 THEN 'strong downward price pressure' ELSE 'moderate downward price pressure' END, ' ',
   CASE WHEN strength > 75 THEN 'with mandatory enforcement' WHEN strength > 50 THEN 'with binding guidance' WHEN strength > 25 THEN 'with voluntary measures' ELSE 'as informational guidance' END) AS overall
FROM scored
""", ("scored",))
def _(t):
    return t.scored.select("doc_id", F.concat_ws(" ", sentiment.price_effect("supply", "demand"), sentiment.enforcement_phrase("strength")).alias("overall"))


@query("P19_strength_levels", """
SELECT source, CAST(count_if(strength > 60) AS BIGINT) AS strong, CAST(count_if(strength < 30) AS BIGINT) AS weak, CAST(count_if(strength BETWEEN 30 AND 60) AS BIGINT) AS rest FROM scored GROUP BY source
""", ("scored",))
def _(t):
    s = F.col("strength")
    return t.scored.groupBy("source").agg(F.count_if(s > 60).alias("strong"), F.count_if(s < 30).alias("weak"), F.count_if(s.between(30, 60)).alias("rest"))


A08_SQL = DAILY + """
SELECT market, effective_date, R6(sentiment_supply) AS sentiment_supply, R6(sentiment_demand) AS sentiment_demand, max_policy, R6(avg_policy) AS avg_policy, doc_count FROM daily
"""


@query("A08_policy_weighted_daily", A08_SQL, ("scored",))
def _(t):
    return rounded(sentiment.daily_weighted(market_docs(t)), "sentiment_supply", "sentiment_demand", "avg_policy")


@query("X01_group_aggregate", A08_SQL, ("scored",))
def _(t):
    docs = market_docs(t).withColumn("w", F.col("strength") + 1)
    sums = docs.groupBy("market", "effective_date").agg(
        F.sum(F.col("supply") * F.col("w")).alias("s"), F.sum(F.col("demand") * F.col("w")).alias("d"), F.sum("w").alias("w"),
        F.max("strength").alias("max_policy"), F.sum("strength").alias("p"), F.count("*").alias("doc_count"))
    return sums.select(
        "market", "effective_date", F.round(F.col("s") / F.col("w"), 6).alias("sentiment_supply"), F.round(F.col("d") / F.col("w"), 6).alias("sentiment_demand"),
        "max_policy", F.round(F.col("p") / F.col("doc_count"), 6).alias("avg_policy"), "doc_count")


@query("A09_documents_per_date", """
WITH c AS (SELECT source, publish_date + 1 AS d, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT source, max(n) AS most, CAST(count_if(n > 1) AS BIGINT) AS shared_dates FROM c GROUP BY source
""", ("scored",))
def _(t):
    per = t.scored.groupBy("source", F.date_add("publish_date", 1).alias("d")).agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("shared_dates"))


LONG = """
long AS (SELECT source, dim, value FROM (SELECT source, supply, demand, strength FROM scored) UNPIVOT (value FOR dim IN (supply, demand, strength)))
"""


def long_scores(t):
    return cleaning.unpivot(t.scored, ["source"], DIMS, name="dim")


@query("A10_feature_statistics", DAILY + """
, p AS (SELECT feature, value FROM (SELECT sentiment_supply, sentiment_demand, max_policy, avg_policy, market_pressure, pressure_magnitude FROM pressed)
        UNPIVOT (value FOR feature IN (sentiment_supply, sentiment_demand, max_policy, avg_policy, market_pressure, pressure_magnitude)))
SELECT feature, count(*) AS n, R5(avg(value)) AS mean, R5(stddev_samp(value)) AS std, R5(min(value)) AS min, R5(max(value)) AS max, R5(quantile_cont(value, 0.5)) AS median FROM p GROUP BY feature
""", ("scored",))
def _(t):
    columns = ["sentiment_supply", "sentiment_demand", "max_policy", "avg_policy", "market_pressure", "pressure_magnitude"]
    daily = sentiment.pressure(sentiment.daily_weighted(market_docs(t)))
    return rounded(statistics.summary(cleaning.unpivot(daily, [], columns)), "mean", "std", "min", "max", "median", places=5)


@query("A11_score_distribution", "WITH " + LONG + """
, e AS (SELECT dim, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM long GROUP BY dim)
SELECT l.dim, CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 10)), 1), 10) AS BIGINT) AS bin, count(*) AS n, R6(any_value(m)) AS mean, R6(any_value(s)) AS std, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75
FROM long l JOIN e USING (dim) GROUP BY 1, 2
""", ("scored",))
def _(t):
    whole = rounded(statistics.distribution(long_scores(t), ["dim"], 10, "right"), "mean", "std")
    return whole.select("dim", "bin", F.col("count").alias("n"), "mean", "std", "q25", "q50", "q75")


@query("A12_fixed_histogram", "WITH " + LONG + """
, e AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM long GROUP BY dim)
SELECT l.dim, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) + 1 AS BIGINT) AS bin, count(*) AS n FROM long l JOIN e USING (dim) GROUP BY 1, 2
""", ("scored",))
def _(t):
    return statistics.histogram(long_scores(t), ["dim"], 30).select("dim", "bin", "n")


@query("A13_correlation_matrix", "WITH p AS (SELECT source, supply AS x1, demand AS x2, strength AS x3 FROM scored) " + " UNION ALL ".join(
    f"SELECT source, '{a}' AS a, '{b}' AS b, R6(corr(x{i + 1}, x{j + 1})) AS corr FROM p GROUP BY source"
    for i, a in enumerate(DIMS) for j, b in enumerate(DIMS)), ("scored",))
def _(t):
    return rounded(statistics.correlations(t.scored, DIMS, ["source"]), "corr")


@query("A14_covariance", """
SELECT source, R6(covar_samp(supply, demand)) AS covariance, R6(var_samp(demand)) AS variance, R6(covar_samp(supply, demand) / var_samp(demand)) AS beta FROM scored GROUP BY source
""", ("scored",))
def _(t):
    return rounded(statistics.beta_parts(t.scored, ["source"], "supply", "demand"), "covariance", "variance", "beta")


@query("A15_yearly_means", """
SELECT CAST(year(publish_date) AS BIGINT) AS year, R6(avg(supply)) AS supply, R6(avg(demand)) AS demand, R6(avg(strength)) AS strength, count(*) AS n
FROM scored WHERE year(publish_date) BETWEEN 1996 AND 2000 GROUP BY 1
""", ("scored",))
def _(t):
    year = F.year("publish_date").cast("long")
    kept = t.scored.filter(year.between(1996, 2000))
    return kept.groupBy(year.alias("year")).agg(*[F.round(F.avg(c), 6).alias(c) for c in DIMS], F.count("*").alias("n"))


@query("A16_outliers", """
WITH l AS (SELECT source, CAST(length(text) AS DOUBLE) AS value FROM scored),
q AS (SELECT source, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM l GROUP BY source),
o AS (SELECT l.source, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS bad FROM l JOIN q USING (source))
SELECT source, CAST(count_if(bad) AS BIGINT) AS n_outliers, R6(100 * avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END)) AS outlier_pct, min(CASE WHEN bad THEN value END) AS least,
       max(CASE WHEN bad THEN value END) AS greatest, R6(avg(CASE WHEN bad THEN value END)) AS mean_outlier FROM o GROUP BY source
""", ("scored",))
def _(t):
    lengths = t.scored.select("source", F.length("text").cast("double").alias("value"))
    return rounded(statistics.outliers(lengths, ["source"]), "outlier_pct", "mean_outlier")


@query("A28_source_profile", """
SELECT source, R6(abs(avg(supply))) AS supply, R6(abs(avg(demand))) AS demand, CASE WHEN abs(avg(supply)) > abs(avg(demand)) THEN 'supply' ELSE 'demand' END AS focus FROM scored GROUP BY source
""", ("scored",))
def _(t):
    s, d = F.abs(F.avg("supply")), F.abs(F.avg("demand"))
    return t.scored.groupBy("source").agg(F.round(s, 6).alias("supply"), F.round(d, 6).alias("demand"), F.when(s > d, "supply").otherwise("demand").alias("focus"))


@query("A31_five_number_summary", "WITH " + LONG + """
SELECT source, dim, R6(avg(value)) AS mean, R6(stddev_samp(value)) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
  quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS low, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS high
FROM long GROUP BY source, dim
""", ("scored",))
def _(t):
    return rounded(statistics.five_numbers(long_scores(t), ["source", "dim"]), "mean", "std")


_LOG_GAMMA = sketches._log_gamma(sketches.ACCURACY)


@query("A31_sketched_quantiles", "WITH " + LONG + f"""
, b AS (SELECT source, dim, value, CASE WHEN abs(value) < 1e-9 THEN 0 ELSE sign(value) END AS s, CASE WHEN abs(value) < 1e-9 THEN 0 ELSE CAST(ceil(ln(abs(value)) / {_LOG_GAMMA}) AS INTEGER) END AS i FROM long),
h AS (SELECT *, row_number() OVER (PARTITION BY source, dim ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY source, dim) AS n, min(value) OVER (PARTITION BY source, dim, s, i) AS lo, max(value) OVER (PARTITION BY source, dim, s, i) AS hi FROM b),
q AS (SELECT *, CASE r WHEN 0 THEN value WHEN n - 1 THEN value ELSE least(greatest(s * 2 * exp(i * {_LOG_GAMMA}) / (exp({_LOG_GAMMA}) + 1), lo), hi) END AS v FROM h)
SELECT source, dim, max(n) AS n, {", ".join(f"R6(max(CASE WHEN r = floor({p}::DOUBLE * (n - 1)) THEN v END)) AS q{int(100 * p)}" for p in (0.25, 0.5, 0.75, 0.95))} FROM q GROUP BY source, dim
""", ("scored",))
def _(t):
    # A sketch per year of publication, as batches would store them, added up.
    path = fresh_path(t.spark, "sketches")
    long = cleaning.unpivot(t.scored, ["source", "publish_date"], DIMS, name="dim").withColumn("batch", F.year("publish_date"))
    sketches.sketch(long, ["batch", "source", "dim"]).write.partitionBy("batch").parquet(path)
    out = sketches.quantiles(sketches.stored(t.spark, path, ["source", "dim"]), ["source", "dim"], [0.25, 0.5, 0.75, 0.95])
    return out.select("source", "dim", "n", *[F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75, 95))])


@query("B27_score_density", """
WITH s AS (SELECT count(*) AS n, var_samp(supply) * pow(count(*), -1.0 / 3) AS a, var_samp(demand) * pow(count(*), -1.0 / 3) AS b, covar_samp(supply, demand) * pow(count(*), -1.0 / 3) AS c FROM scored),
m AS (SELECT i.range AS i, j.range AS j, -150 + i.range * 15.0 AS x, -150 + j.range * 15.0 AS y FROM range(21) i, range(21) j)
SELECT i, j, R9(sum(exp(-0.5 * (b * (x - supply) ** 2 - 2 * c * (x - supply) * (y - demand) + a * (y - demand) ** 2) / (a * b - c * c))) / (any_value(n) * 2 * pi() * sqrt(any_value(a * b - c * c)))) AS density,
       (SELECT count(*) FROM scored WHERE floor(supply / 15) = i - 10 AND floor(demand / 15) = j - 10) AS n
FROM m, s, scored GROUP BY i, j
""", ("scored",))
def _(t):
    smooth = density.kernel_density_2d(t.scored, "supply", "demand", 21, -150.0, 150.0)
    counts = statistics.grid_counts(t.scored, "supply", "demand", 15.0).select(
        (F.col("cell_x") + 10).alias("i"), (F.col("cell_y") + 10).alias("j"), "n")
    joined = smooth.select(F.col("i"), F.col("j").cast("long").alias("j"), "density").join(counts, ["i", "j"], "left")
    return joined.select("i", "j", F.round("density", 9).alias("density"), F.coalesce("n", F.lit(0)).alias("n"))


@query("W16_momentum", DAILY + """
, r AS (SELECT market, effective_date, doc_count / (avg(doc_count) OVER (PARTITION BY market ORDER BY effective_date ROWS 6 PRECEDING) + 0.1) AS shock,
   avg(market_pressure) OVER w AS p, avg(sentiment_supply) OVER w AS s, avg(sentiment_demand) OVER w AS d FROM pressed WINDOW w AS (PARTITION BY market ORDER BY effective_date ROWS 2 PRECEDING))
SELECT market, effective_date, R6(shock) AS news_shock, R6(p - lag(p) OVER w) AS pressure_momentum, R6(s - lag(s) OVER w) AS supply_momentum, R6(d - lag(d) OVER w) AS demand_momentum
FROM r WINDOW w AS (PARTITION BY market ORDER BY effective_date)
""", ("scored",))
def _(t):
    out = sentiment.momentum(sentiment.pressure(sentiment.daily_weighted(market_docs(t))))
    names = ("news_shock", "pressure_momentum", "supply_momentum", "demand_momentum")
    return rounded(out.select("market", "effective_date", *names), *names)


DECAYED_AT = """
SELECT a.market, a.effective_date, {cols}
FROM {dates} a JOIN sums b ON b.market = a.market AND b.effective_date <= a.effective_date GROUP BY a.market, a.effective_date
"""
_TERM = "R6(sum(b.{c} * pow(0.5, date_diff('day', b.effective_date, a.effective_date) / 7.0))) AS {n}_decayed"
DECAY_COLS = ", ".join(_TERM.format(c=c, n=n) for c, n in (("s", "supply"), ("d", "demand"), ("p", "policy")))


@query("W17_decayed_influence", "WITH " + DOCS + DECAY + DECAYED_AT.format(cols=DECAY_COLS, dates="sums"), ("scored",))
def _(t):
    return rounded(sentiment.decayed_influence(market_docs(t)), "supply_decayed", "demand_decayed", "policy_decayed")


_DAY_TERM = "R6(coalesce(sum(b.{c} * pow(0.5, date_diff('day', b.effective_date, a.effective_date) / 7.0)), 0)) AS {n}_decayed"
DAY_COLS = ", ".join(_DAY_TERM.format(c=c, n=n) for c, n in (("s", "supply"), ("d", "demand"), ("p", "policy")))


@query("J08_decay_range_join", "WITH " + DOCS + DECAY + ", days AS (SELECT market, date AS effective_date FROM px)" + f"""
SELECT a.market, a.effective_date, {DAY_COLS}
FROM days a LEFT JOIN sums b ON b.market = a.market AND b.effective_date <= a.effective_date GROUP BY a.market, a.effective_date
""", ("scored", "px"))
def _(t):
    days = t.px.select("market", F.col("date").alias("effective_date"))
    return rounded(sentiment.decayed_influence(market_docs(t), dates=days), "supply_decayed", "demand_decayed", "policy_decayed")


@query("F17_market_pressure", DAILY + "SELECT market, effective_date, R6(market_pressure + 1e-9) AS market_pressure, R6(pressure_magnitude + 1e-9) AS pressure_magnitude FROM pressed", ("scored",))
def _(t):
    out = sentiment.pressure(sentiment.daily_weighted(market_docs(t)))
    # Weights that are powers of two give exact halves in the last place; a nudge rounds them alike in both engines.
    return out.select("market", "effective_date", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("market_pressure", "pressure_magnitude")])


MERGED = ["sentiment_supply", "sentiment_demand", "doc_count"]


@query("J03_same_day_merge", DAILY + """
SELECT p.market, p.date, p.close, R6(coalesce(sentiment_supply, 0)) AS sentiment_supply, R6(coalesce(sentiment_demand, 0)) AS sentiment_demand, coalesce(doc_count, 0) AS doc_count
FROM px p LEFT JOIN daily d ON d.market = p.market AND d.effective_date = p.date
""", ("px", "scored"))
def _(t):
    merged = sentiment.merge_same_day(t.px.select("market", "date", "close"), sentiment.daily_weighted(market_docs(t)), MERGED)
    return rounded(merged, "sentiment_supply", "sentiment_demand")


@query("P20_zero_fill_after_join", DAILY + """
SELECT p.market, p.date, coalesce(max_policy, 0) AS max_policy FROM px p LEFT JOIN daily d ON d.market = p.market AND d.effective_date = p.date
""", ("px", "scored"))
def _(t):
    return sentiment.merge_same_day(t.px.select("market", "date"), sentiment.daily_weighted(market_docs(t)), ["max_policy"])


@query("J04_as_of_merge", DAILY + """
SELECT p.market, p.date, p.close, R6(sentiment_supply) AS sentiment_supply, R6(sentiment_demand) AS sentiment_demand, doc_count
FROM px p ASOF LEFT JOIN daily d ON d.market = p.market AND d.effective_date <= p.date
""", ("px", "scored"))
def _(t):
    merged = sentiment.merge_as_of(t.px.select("market", "date", "close"), sentiment.daily_weighted(market_docs(t)), MERGED)
    return rounded(merged, "sentiment_supply", "sentiment_demand")


@query("T03_extreme_documents", "WITH " + """
long AS (SELECT doc_id, dim, value FROM (SELECT doc_id, supply, demand, strength FROM scored) UNPIVOT (value FOR dim IN (supply, demand, strength))),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value DESC, doc_id) AS t, row_number() OVER (PARTITION BY dim ORDER BY value, doc_id) AS b FROM long)
SELECT dim, 'top' AS side, t AS rank, doc_id, value FROM r WHERE t <= 5 UNION ALL SELECT dim, 'bottom', b, doc_id, value FROM r WHERE b <= 5
""", ("scored",))
def _(t):
    from marketloom.operators.ordering import top_per_key

    long = cleaning.unpivot(t.scored, ["doc_id"], DIMS, name="dim")
    top = top_per_key(long, ["dim"], [F.desc("value"), F.asc("doc_id")], 5).withColumn("side", F.lit("top"))
    bottom = top_per_key(long, ["dim"], [F.asc("value"), F.asc("doc_id")], 5).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("dim", "side", F.col("rank").cast("long").alias("rank"), "doc_id", "value")

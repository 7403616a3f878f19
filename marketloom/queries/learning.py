"""Learning data, model and reversal queries, and the slot selection of documents."""

from pyspark.sql import functions as F

from marketloom.operators import boosting, learning, logistic, sentiment, slots, tournament, weekly
from marketloom.operators.series import ordered
from marketloom.plans import flows
from marketloom.queries.features import EWM
from marketloom.queries.registry import query
from marketloom.queries.sentiment import market_docs, rounded
from marketloom.session import settle

M = ["market"]
MW = ["market", "walk"]


@query("M01_direction_label", """
SELECT market, date, CASE WHEN c > 0 THEN 1 WHEN c <= 0 THEN 0 END AS y FROM (SELECT market, date, ln(close / lag(close) OVER (PARTITION BY market ORDER BY date)) AS c FROM px)
""", ("px",))
def _(t):
    r = F.ln(F.col("close") / F.lag("close").over(ordered(M)))
    return t.px.select("market", "date", r.alias("log_return")).select("market", "date", learning.label().alias("y"))


WALKS = """
n AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM {src}),
k AS (SELECT n.*, w.range AS walk, i - {off} - w.range * {step} AS place FROM n, unnest(range(n.n // {step} + 1)) AS w(range)
      WHERE w.range < floor((n - {length} - {reserve}) / {step}) + 1 AND i - {off} - w.range * {step} BETWEEN 0 AND {length} - 1 {whole}),
walks AS (SELECT *, CASE WHEN place < {train} THEN 'train' WHEN place < {train} + {val} THEN 'val' ELSE 'test' END AS role FROM k)
"""
DAILY_WALKS = WALKS.format(src="px", off=0, step=150, length=1050, reserve=60, train=700, val=150, whole="AND w.range * 150 + 1050 <= n")

WEEKS = """
week AS (SELECT market, max(date) AS date, arg_max(close, date) AS close, avg(vwap) AS vwap, sum(volume) AS volume, sum(turnover) AS turnover
         FROM px GROUP BY market, date_trunc('week', date) HAVING count(*) >= 3)
"""
WEEKLY_WALKS = WALKS.format(src="week", off=12, step=20, length=230, reserve=12, train=180, val=20, whole="")


@query("A17_weekly_roll_up", "WITH " + WEEKS + "SELECT market, date, close, R6(vwap) AS vwap, volume, R2(turnover) AS turnover FROM week", ("px",))
def _(t):
    return weekly.roll_up(t.px, M).withColumns({"vwap": F.round("vwap", 6), "turnover": F.round("turnover", 2)})


_WEEK_ROWS = "OVER (PARTITION BY market ORDER BY date ROWS 19 PRECEDING)"


@query("A17_weekly_technical", "WITH " + WEEKS + "," + EWM.replace("WITH d AS", "d AS").replace("FROM px", "FROM week") + f"""
SELECT w.market, w.date, R6(ln(close / lag(close) OVER o)) AS log_return, R6(close / lag(close, 5) OVER o - 1) AS return_5d,
  R6(4 * stddev_samp(close) {_WEEK_ROWS} / nullif(avg(close) {_WEEK_ROWS}, 0)) AS bb_width, R6(avg(volume) {_WEEK_ROWS}) AS volume_sma_20,
  R6(CASE WHEN k >= 13 THEN 100 - 100 / (1 + gain / nullif(loss, 0)) END) AS rsi_14
FROM week w LEFT JOIN z ON z.market = w.market AND z.date = w.date WINDOW o AS (PARTITION BY w.market ORDER BY w.date)
""".replace("PARTITION BY market ORDER BY date", "PARTITION BY w.market ORDER BY w.date"), ("px",))
def _(t):
    names = ["log_return", "return_5d", "bb_width", "volume_sma_20", "rsi_14"]
    return rounded(weekly.panel(t.px).select("market", "date", *names), *names)


@query("M02_daily_walks", "WITH " + DAILY_WALKS + "SELECT market, date, walk, role FROM walks", ("px",))
def _(t):
    w = learning.assign_walks(t.px.select("market", "date"), M, learning.DAILY)
    return w.withColumn("walk", F.col("walk").cast("long"))


@query("M03_weekly_walks", "WITH " + WEEKS + "," + WEEKLY_WALKS + "SELECT market, date, walk, role FROM walks", ("px",))
def _(t):
    w = learning.assign_walks(weekly.roll_up(t.px.select("market", "date", "close"), M).select("market", "date"), M, learning.WEEKLY)
    return w.withColumn("walk", F.col("walk").cast("long"))


def daily_rows(t):
    r = F.ln(F.col("close") / F.lag("close").over(ordered(M)))
    df = t.px.select("market", "date", "close", "vwap", r.alias("log_return")).filter("log_return IS NOT NULL")
    return learning.assign_walks(df.withColumn("y", learning.label()), M, learning.DAILY)


LABELLED = "WITH lab AS (SELECT * FROM (SELECT market, date, close, vwap, ln(close / lag(close) OVER (PARTITION BY market ORDER BY date)) AS log_return FROM px) WHERE log_return IS NOT NULL), " + DAILY_WALKS.replace("FROM px)", "FROM lab)") + """
, rows_ AS (SELECT *, CASE WHEN log_return > 0 THEN 1 ELSE 0 END AS y FROM walks)
"""


@query("M04_daily_sequences", LABELLED + """
, s AS (SELECT market, walk, role, date, y, row_number() OVER p AS j, first_value(close) OVER f AS first_close, last_value(close) OVER f AS last_close, max(vwap) OVER f AS max_vwap
   FROM rows_ WINDOW p AS (PARTITION BY market, walk, role ORDER BY date), f AS (PARTITION BY market, walk, role ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT market, walk, role, date, y, first_close, last_close, max_vwap FROM s WHERE j > 60
""", ("px",))
def _(t):
    s = learning.sequences(daily_rows(t), ["market", "walk", "role"], ["close", "vwap"], 60)
    return s.select(
        "market", F.col("walk").cast("long").alias("walk"), "role", "date", "y", F.col("x")[0][0].alias("first_close"),
        F.col("x")[59][0].alias("last_close"), F.array_max(F.transform("x", lambda v: v[1])).alias("max_vwap"))


@query("M05_weekly_sequences", "WITH " + WEEKS + "," + WEEKLY_WALKS + """
, s AS (SELECT market, walk, role, date, row_number() OVER p AS j, first_value(close) OVER f AS first_close, close AS last_close
   FROM walks WINDOW p AS (PARTITION BY market, walk, role ORDER BY date), f AS (PARTITION BY market, walk, role ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT market, walk, role, date, first_close, last_close FROM s WHERE j >= 12
""", ("px",))
def _(t):
    w = learning.assign_walks(weekly.roll_up(t.px.select("market", "date", "close"), M), M, learning.WEEKLY)
    s = learning.sequences(w, ["market", "walk", "role"], ["close"], 12, include_label_row=True)
    return s.select(
        "market", F.col("walk").cast("long").alias("walk"), "role", "date", F.col("x")[0][0].alias("first_close"), F.col("x")[11][0].alias("last_close"))


@query("M06_min_max_scaling", LABELLED + """
, l AS (SELECT market, walk, min(close) AS a, max(close) AS b, min(vwap) AS c, max(vwap) AS d FROM rows_ WHERE role = 'train' GROUP BY market, walk)
SELECT r.market, r.walk, role, date, R6((close - a) / CASE WHEN b = a THEN 1 ELSE b - a END) AS close, R6((vwap - c) / CASE WHEN d = c THEN 1 ELSE d - c END) AS vwap
FROM rows_ r JOIN l ON l.market = r.market AND l.walk = r.walk
""", ("px",))
def _(t):
    s = learning.scaled(daily_rows(t), MW, ["close", "vwap"])
    return rounded(s.select("market", F.col("walk").cast("long").alias("walk"), "role", "date", "close", "vwap"), "close", "vwap")


@query("M07_class_weight", LABELLED + """
SELECT market, walk, R6(CAST(count_if(y = 0) AS DOUBLE) / nullif(count_if(y = 1), 0)) AS pos_weight FROM rows_ WHERE role = 'train' GROUP BY market, walk
""", ("px",))
def _(t):
    return rounded(learning.class_weight(daily_rows(t), MW).withColumn("walk", F.col("walk").cast("long")), "pos_weight")


@query("M08_direction_classifier")
def _(t):
    rows = learning.scaled(daily_rows(t), MW, ["close", "vwap"])
    seq, columns = logistic.sequence_summaries(rows, ["market", "walk", "role"], ["close", "vwap", "log_return"], 60)
    probs = logistic.walk_probabilities(seq, MW, columns)
    return probs.withColumn("pred", learning.decide())


@query("M09_threshold_decision", "SELECT market, date, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM pred", ("pred",))
def _(t):
    return t.pred.select("market", "date", learning.decide().alias("pred"))


METRICS = """CAST(count_if({p} = 1 AND {a} = 1) AS BIGINT) AS tp, CAST(count_if({p} = 0 AND {a} = 0) AS BIGINT) AS tn, CAST(count_if({p} = 1 AND {a} = 0) AS BIGINT) AS fp, CAST(count_if({p} = 0 AND {a} = 1) AS BIGINT) AS fn"""
RATES = """CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
 coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS specificity"""


@query("M10_classification_metrics", f"""
WITH c AS (SELECT source, {METRICS.format(p='quality', a='toxic')} FROM labels JOIN documents USING (doc_id) GROUP BY source), r AS (SELECT source, tp, tn, fp, fn, {RATES} FROM c)
SELECT source, tp, tn, fp, fn, R6(accuracy) AS accuracy, R6(precision) AS precision, R6(recall) AS recall, R6(f1) AS f1, R6(specificity) AS specificity, R6(recall) AS sensitivity FROM r
""")
def _(t):
    pairs = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    m = learning.classification_metrics(pairs, ["source"], "quality", "toxic")
    return rounded(m, "accuracy", "precision", "recall", "f1", "specificity", "sensitivity")


@query("M11_chronological_split", """
WITH n AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM pred)
SELECT market, date, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM n
""", ("pred",))
def _(t):
    return learning.chronological_split(t.pred, M).select("market", "date", "part")


@query("M12_error_target", "SELECT market, R6(avg(CAST(pred <> actual AS INTEGER))) AS error_rate, CAST(sum(CAST(pred <> actual AS INTEGER)) AS BIGINT) AS errors FROM pred GROUP BY market", ("pred",))
def _(t):
    wrong = (F.col("pred") != F.col("actual")).cast("int")
    return t.pred.groupBy("market").agg(F.round(F.avg(wrong), 6).alias("error_rate"), F.sum(wrong).alias("errors"))


FEATURES = [*learning.PREDICTION_INPUTS, *learning.SENTIMENT_INPUTS, *learning.AGREEMENT_INPUTS]
MF = ["market", "frequency"]


def error_rows(t):
    docs = settle(market_docs(t).select("market", "effective_date", "supply", "demand", "strength"))
    return settle(learning.chronological_split(flows.error_rows(t.pred, sentiment.daily_sentiment(docs)), MF))


@query("M13_error_predictor")
def _(t):
    rows = error_rows(t)
    model = boosting.fit(rows.filter("part = 'train'"), MF, ["date"], FEATURES, "wrong")
    later = boosting.probabilities(rows.filter("part <> 'train'"), MF, FEATURES, model)
    return later.select("market", "frequency", "date", "part", "pred", "actual", "p_err")


@query("T04_feature_importances")
def _(t):
    train = error_rows(t).filter("part = 'train'")
    return boosting.importances(boosting.fit(train, MF, ["date"], FEATURES, "wrong"), MF, FEATURES, 10)


# A fixed error probability per row stands in for the model, so that both engines see the same one. The threshold is chosen
# on the validation part and judged on the test part.
ERRS = """
cut AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM pred),
errs AS (SELECT market, date, prob, pred, actual, e * e AS p_err, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS part
         FROM (SELECT *, CAST((date_diff('day', DATE '1995-01-01', date) * 57 + length(market) * 13) % 1000 AS DOUBLE) / 1000 AS e FROM cut))
"""


def with_error(t):
    e = ((F.datediff("date", F.lit("1995-01-01").cast("date")) * 57 + F.length("market") * 13) % 1000).cast("double") / 1000
    return learning.chronological_split(t.pred.withColumn("_e", e).withColumn("p_err", F.col("_e") * F.col("_e")).drop("_e", "close"), M)


THR = """
thr AS (SELECT 0.4::DOUBLE + 0.05::DOUBLE * range AS threshold FROM range(8)),
tab AS (SELECT market, threshold, avg(CASE WHEN (p_err > threshold) <> (pred = actual) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN p_err > threshold THEN 1.0 ELSE 0.0 END) AS reversal_rate
        FROM errs, thr WHERE part = 'val' GROUP BY market, threshold),
best AS (SELECT market, coalesce(arg_min(threshold, (-accuracy, threshold)) FILTER (reversal_rate < 0.3 AND accuracy > 0), 0.6::DOUBLE) AS threshold, coalesce(max(accuracy) FILTER (reversal_rate < 0.3 AND accuracy > 0), 0) AS accuracy FROM tab GROUP BY market)
"""


@query("M14_threshold_search", "WITH " + ERRS + "," + THR + "SELECT market, R6(threshold) AS threshold, R6(accuracy) AS accuracy FROM best", ("pred",))
def _(t):
    return rounded(learning.best_threshold(with_error(t).filter("part = 'val'"), M), "threshold", "accuracy")


def reversed_rows(t):
    rows = settle(with_error(t))
    best = learning.best_threshold(rows.filter("part = 'val'"), M).select("market", "threshold")
    return learning.reverse(rows.filter("part = 'test'").join(best, "market"), F.col("threshold"))


REV = "WITH " + ERRS + "," + THR + """
, rev AS (SELECT e.*, p_err > threshold AS rv, CASE WHEN p_err > threshold THEN 1 - pred ELSE pred END AS final FROM errs e JOIN best USING (market) WHERE part = 'test')
"""

@query("M15_selective_reversal", REV + "SELECT market, date, pred, rv AS reversed, final FROM rev", ("pred",))
def _(t):
    return reversed_rows(t).select("market", "date", "pred", "reversed", "final")


@query("M16_reversal_metrics", REV + f"""
, c AS (SELECT market, avg(CAST(pred = actual AS INTEGER)) AS baseline, avg(CAST(final = actual AS INTEGER)) AS fin, avg(CAST(rv AS INTEGER)) AS rate, CAST(count_if(rv) AS BIGINT) AS reversed_count, count(*) AS total_samples,
   coalesce(avg(CASE WHEN rv THEN CAST(final = actual AS INTEGER) END), 0) AS rc, coalesce(avg(CASE WHEN NOT rv THEN CAST(final = actual AS INTEGER) END), 0) AS kc, {METRICS.format(p='final', a='actual')} FROM rev GROUP BY market),
 d AS (SELECT *, {RATES} FROM c)
SELECT market, R6(baseline) AS baseline_accuracy, R6(fin) AS final_accuracy, R6(fin - baseline) AS improvement, R6(rate) AS reversal_rate, reversed_count, total_samples, R6(rc) AS reversals_correct,
  R6(CASE WHEN reversed_count > 0 THEN kc ELSE baseline END) AS kept_correct, R6(precision) AS precision, R6(recall) AS recall, R6(f1) AS f1 FROM d
""", ("pred",))
def _(t):
    m = learning.reversal_metrics(reversed_rows(t), M)
    return rounded(m, *[c for c in m.columns if c not in ("market", "reversed_count", "total_samples")])


@query("M17_reversal_buckets", REV + """
SELECT market, CASE WHEN p_err < 0.6 THEN '0.5-0.6' WHEN p_err < 0.7 THEN '0.6-0.7' WHEN p_err < 0.8 THEN '0.7-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n, R6(avg(CAST(final = actual AS INTEGER))) AS success
FROM rev WHERE rv AND p_err >= 0.5 AND p_err < 1 GROUP BY 1, 2
""", ("pred",))
def _(t):
    return rounded(learning.reversal_buckets(reversed_rows(t), M), "success")


MODELS = "models AS (SELECT k AS model, market, date, CASE WHEN q > 500 THEN 1 ELSE 0 END AS pred, CAST(q AS DOUBLE) / 1000 AS prob FROM (SELECT k, market, date, CAST(round(prob * 1000) AS BIGINT) * k % 1000 AS q FROM pred, (VALUES (1), (3), (7)) v(k)))"


@query("M18_ensemble_vote", "WITH " + MODELS + "SELECT market, date, CASE WHEN sum(pred) >= 2 THEN 1 ELSE 0 END AS majority, CASE WHEN sum(CAST(round(prob * 1000) AS BIGINT)) > 1500 THEN 1 ELSE 0 END AS average FROM models GROUP BY market, date", ("pred",))
def _(t):
    k = F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("model")
    q = F.round(F.col("prob") * 1000).cast("long") * F.col("model") % 1000
    models = t.pred.select("market", "date", "prob", k).withColumn("prob", q.cast("double") / 1000).withColumn("pred", learning.decide())
    return learning.ensemble(models)


@query("M19_signal_kinds", """
SELECT market, date, 'binary' AS kind, CAST(pred AS DOUBLE) AS signal FROM pred UNION ALL SELECT market, date, 'scaled', R6(CASE WHEN prob > 0.5 THEN abs(prob - 0.5) * 2 ELSE 0 END) FROM pred
UNION ALL SELECT market, date, 'threshold', CASE WHEN prob > 0.5 THEN 1 ELSE 0 END FROM pred UNION ALL SELECT market, date, 'confident', CASE WHEN prob > 0.7 THEN 1 ELSE 0 END FROM pred
""", ("pred",))
def _(t):
    return rounded(learning.signal_kinds(t.pred, ["market", "date"]), "signal")


@query("M20_accuracy_by_confidence", """
WITH b AS (SELECT market, pred = actual AS hit, prob > 0.7 OR prob < 0.3 AS sure FROM pred)
SELECT market, 'high' AS band, R6(coalesce(avg(CASE WHEN sure THEN CAST(hit AS INTEGER) END), 0)) AS accuracy FROM b GROUP BY market
UNION ALL SELECT market, 'mid', R6(coalesce(avg(CASE WHEN NOT sure THEN CAST(hit AS INTEGER) END), 0)) FROM b GROUP BY market
UNION ALL SELECT market, 'all', R6(avg(CAST(hit AS INTEGER))) FROM b GROUP BY market
""", ("pred",))
def _(t):
    return rounded(learning.accuracy_by_confidence(t.pred, M), "accuracy")


@query("F18_entropy_confidence", "SELECT market, date, R6(abs(prob - 0.5) * 2) AS confidence, R6(-(prob * ln(prob + 1e-8) + (1 - prob) * ln(1 - prob + 1e-8))) AS entropy FROM pred", ("pred",))
def _(t):
    return rounded(learning.error_features(t.pred).select("market", "date", "confidence", "entropy"), "confidence", "entropy")


@query("F19_uncertainty_flags", "SELECT market, date, CAST(abs(prob - 0.5) < 0.1 AS INTEGER) AS uncertain, CAST(prob > 0.8 OR prob < 0.2 AS INTEGER) AS extreme FROM pred", ("pred",))
def _(t):
    return learning.error_features(t.pred).select("market", "date", "uncertain", "extreme")


@query("F20_sentiment_agreement", """
WITH s AS (SELECT *, close - 150 AS m, CASE WHEN close - 150 > 0 THEN 1 ELSE 0 END AS g FROM pred)
SELECT market, date, CAST(g = pred AS INTEGER) AS agrees, CAST(abs(m) > 20 AND g <> pred AS INTEGER) AS strong_disagree, R8(prob * m) AS interaction FROM s
""", ("pred",))
def _(t):
    rows = learning.error_features(t.pred.withColumn("sentiment_mean", F.col("close") - 150), sentiment="sentiment_mean")
    return rounded(rows.select("market", "date", "agrees", "strong_disagree", "interaction"), "interaction", places=8)


WALKM = f"wm AS (SELECT market, CAST(year(date) - 1995 AS BIGINT) AS walk, count(*) AS n, {METRICS.format(p='pred', a='actual')} FROM pred GROUP BY 1, 2), mm AS (SELECT *, {RATES} FROM wm)"


def walk_metrics(t):
    rows = t.pred.withColumn("walk", (F.year("date") - 1995).cast("long"))
    m = learning.classification_metrics(rows, MW)
    return m.withColumn("n", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


@query("A25_walk_aggregate", "WITH " + WALKM + """
SELECT market, R6(avg(accuracy)) AS accuracy_mean, R6(avg(f1)) AS f1_mean, R6(stddev_pop(accuracy)) AS accuracy_std, R6(stddev_pop(f1)) AS f1_std, count(*) AS n_walks, CAST(sum(n) AS BIGINT) AS total_samples,
  arg_min(walk, (-f1, walk)) AS best_walk FROM mm GROUP BY market
""", ("pred",))
def _(t):
    return rounded(learning.walk_aggregate(walk_metrics(t), M, ["accuracy", "f1"]), "accuracy_mean", "f1_mean", "accuracy_std", "f1_std")


@query("A26_walk_trend", "WITH " + WALKM + """
SELECT market, R6(regr_slope(f1, walk)) AS slope, R6(regr_intercept(f1, walk)) AS intercept, CASE WHEN regr_slope(f1, walk) > 0.001 THEN 'Improving' WHEN regr_slope(f1, walk) < -0.001 THEN 'Declining' ELSE 'Stable' END AS trend FROM mm GROUP BY market
""", ("pred",))
def _(t):
    return rounded(learning.walk_trend(walk_metrics(t), M), "slope", "intercept")


@query("A27_mean_learning_curve", """
WITH c AS (SELECT market, year(date) AS y, prob, row_number() OVER (PARTITION BY market, year(date) ORDER BY date) - 1 AS epoch FROM pred)
SELECT market, epoch, R6(avg(prob)) AS value, count(*) AS n FROM c GROUP BY market, epoch
""", ("pred",))
def _(t):
    # A curve holds the days of one year.
    curves = t.pred.groupBy("market", F.year("date").alias("y")).agg(F.array_sort(F.collect_list(F.struct("date", "prob"))).alias("c"))
    out = learning.mean_curve(curves.withColumn("c", F.col("c.prob")), M, "c")
    return rounded(out.withColumn("epoch", F.col("epoch").cast("long")), "value")


CANDIDATES = """
cand AS (SELECT doc_id, 'supply' AS dimension, CASE WHEN supply <= -75 THEN 'restrict' WHEN supply < 0 THEN 'reduce' WHEN supply < 75 THEN 'increase' ELSE 'expand' END AS category, abs(supply) AS score FROM scored
  UNION ALL SELECT doc_id, 'demand', CASE WHEN demand <= -75 THEN 'restrict' WHEN demand < 0 THEN 'reduce' WHEN demand < 75 THEN 'increase' ELSE 'expand' END, abs(demand) FROM scored
  UNION ALL SELECT doc_id, 'policy_strength', CASE WHEN strength > 75 THEN 'mandatory' WHEN strength > 50 THEN 'binding' WHEN strength > 25 THEN 'encouraged' ELSE 'informational' END, strength FROM scored)
"""


@query("T08_best_per_slot", "WITH " + CANDIDATES + """
SELECT doc_id // 20 AS "group", dimension, category, arg_min(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score FROM cand GROUP BY 1, 2, 3
""", ("scored",))
def _(t):
    c = slots.classify(t.scored.select("doc_id", "supply", "demand", "strength"))
    return slots.best_per_slot(c.withColumn("group", F.floor(F.col("doc_id") / 20)), ["group"])


@query("T08_slot_tournament", "WITH " + CANDIDATES + """
SELECT doc_id // 20 AS "group", dimension, category, arg_min(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score FROM cand GROUP BY 1, 2, 3
""", ("scored",))
def _(t):
    c = slots.classify(t.scored.select("doc_id", "supply", "demand", "strength")).withColumn("group", F.floor(F.col("doc_id") / 20))
    won = tournament.bracket(c.select("group", *slots.SLOT, "doc_id", "score"), ["group", *slots.SLOT], ["doc_id"], tournament.by_score())
    return won.select("group", *slots.SLOT, "won.doc_id", "won.score")


def merged(t, judge=None):
    return slots.merged_slots(slots.classify(t.scored.select("doc_id", "supply", "demand", "strength")), judge)


MERGED = "WITH " + CANDIDATES + """
, r AS (SELECT *, row_number() OVER (PARTITION BY dimension, category ORDER BY score DESC, doc_id) AS i FROM cand),
grid(dimension, category, position) AS (VALUES ('supply', 'restrict', -100), ('supply', 'reduce', -50), ('supply', 'increase', 50), ('supply', 'expand', 100),
  ('demand', 'restrict', -100), ('demand', 'reduce', -50), ('demand', 'increase', 50), ('demand', 'expand', 100),
  ('policy_strength', 'informational', 0), ('policy_strength', 'encouraged', 33), ('policy_strength', 'binding', 67), ('policy_strength', 'mandatory', 100)),
m AS (SELECT g.*, coalesce(b.doc_id, o.doc_id) AS doc_id, coalesce(b.score, o.score) AS score, b.doc_id IS NULL AND o.doc_id IS NOT NULL AS adapted FROM grid g
  LEFT JOIN r b ON b.dimension = g.dimension AND b.category = g.category AND b.i = 1
  LEFT JOIN r o ON o.dimension = g.dimension AND g.dimension <> 'policy_strength' AND o.i = 2 AND ((o.category = 'restrict' AND g.category = 'reduce') OR (o.category = 'expand' AND g.category = 'increase')))
"""


@query("T09_merged_slots", MERGED + "SELECT dimension, category, position, doc_id, score, CASE WHEN doc_id IS NULL THEN 'empty' ELSE 'filled' END AS status, adapted FROM m", ("scored",))
def _(t):
    return merged(t)


@query("T09_slots_by_tournament", MERGED + "SELECT dimension, category, position, doc_id, score, CASE WHEN doc_id IS NULL THEN 'empty' ELSE 'filled' END AS status, adapted FROM m", ("scored",))
def _(t):
    return merged(t, tournament.compared_by(lambda slot, a, b: a["score"] >= b["score"]))


@query("T10_slot_fill_summary", MERGED + "SELECT count(*) AS total_slots, count(doc_id) AS filled, count(*) - count(doc_id) AS empty, R6(100.0 * count(doc_id) / count(*)) AS fill_rate FROM m", ("scored",))
def _(t):
    return rounded(slots.fill_summary(merged(t)), "fill_rate")


@query("F22_nested_json_build", MERGED + """
, e AS (SELECT dimension, category, '"' || category || '":{"status":"' || CASE WHEN doc_id IS NULL THEN 'empty' ELSE 'filled' END || '","document":' ||
  CASE WHEN doc_id IS NULL THEN 'null' ELSE '{"doc_id":' || doc_id || ',"score":' || score || '}' END || '}' AS entry FROM m),
d AS (SELECT dimension, '"' || dimension || '":{' || string_agg(entry, ',' ORDER BY category) || '}' AS entry FROM e GROUP BY dimension)
SELECT '{' || string_agg(entry, ',' ORDER BY dimension) || '}' AS value FROM d
""", ("scored",))
def _(t):
    return slots.nested_json(merged(t), ["doc_id", "score"])


@query("F23_nested_json_walk", MERGED + "SELECT dimension, category, doc_id, score FROM m", ("scored",))
def _(t):
    return slots.read_nested_json(slots.nested_json(merged(t), ["doc_id", "score"]))


@query("F24_validated_replies", "WITH " + CANDIDATES + "SELECT doc_id, dimension, category FROM cand WHERE doc_id % 3 <> 0 AND (dimension <> 'demand' OR doc_id % 5 <> 0)", ("scored",))
def _(t):
    c = slots.classify(t.scored.select("doc_id", "supply", "demand", "strength"))
    wrong = F.when((F.col("dimension") == "demand") & (F.col("doc_id") % 5 == 0), "mandatory").otherwise(F.col("category"))
    # Three pairs per document.
    reply = c.groupBy("doc_id").agg(F.collect_list(F.struct("dimension", wrong.alias("category"))).alias("classifications"))
    body = F.when(F.col("doc_id") % 3 == 0, "no json").otherwise(F.to_json(F.struct("classifications")))
    return slots.replies(reply.select("doc_id", body.alias("reply")), "reply")

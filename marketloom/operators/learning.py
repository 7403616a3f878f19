"""Learning data and models: walk-forward splits, scaling, sequences, classifiers, metrics, error reversal.

A walk has a fixed number of rows, so everything per (series, walk) is bounded by the split parameters; the number of
series and walks is what grows, and they are keys of one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.series import ordered


@dataclass(frozen=True)
class Split:
    """Row counts of a walk-forward split; ``most`` walks at most, all that the series has room for if None."""

    train: int
    validation: int
    test: int
    step: int
    most: int | None = None
    offset: int = 0
    reserve: int = 0
    clip: bool = False

    @property
    def length(self) -> int:
        return self.train + self.validation + self.test


# The daily and weekly splits. The published runs stop after 10 and 14 walks (``most``).
DAILY = Split(700, 150, 200, 150, reserve=60)
WEEKLY = Split(180, 20, 30, 20, offset=12, reserve=12, clip=True)


def label(c: str = "log_return") -> Column:
    """1 for a rise, 0 for a fall or no change."""
    return (F.col(c) > 0).cast("int")


def assign_walks(df: DataFrame, keys: Sequence[str], split: Split, date: str = "date") -> DataFrame:
    """Long (walk, role) assignment; a row appears once in each walk whose window covers it."""
    rows = df.withColumn("_i", F.row_number().over(ordered(keys, date)) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*keys)))
    walks = F.floor((F.col("_n") - split.length - split.reserve) / split.step) + 1
    if split.most is not None:
        walks = F.least(walks, F.lit(split.most))
    at = F.col("_i") - split.offset
    first = F.greatest(F.ceil((at - (split.length - 1)) / split.step), F.lit(0))
    last = F.least(F.floor(at / split.step), walks - 1)
    if not split.clip:
        whole = F.floor((F.col("_n") - split.length - split.offset) / split.step)
        last = F.least(last, whole)
    spread = (
        rows.withColumn("_first", first.cast("int")).withColumn("_last", last.cast("int"))
        .filter((F.col("_first") <= F.col("_last")) & (F.col("_i") >= split.offset))
        .withColumn("walk", F.explode(F.sequence("_first", "_last"))))
    place = F.col("_i") - split.offset - F.col("walk") * split.step
    role = F.when(place < split.train, "train").when(place < split.train + split.validation, "val").otherwise("test")
    return spread.withColumn("role", role).drop("_i", "_n", "_first", "_last")


def scaled(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns to the range the training rows of the same walk span; other rows may leave it.

    The limits are one row per (series, walk); Catalyst picks the join from their size.
    """
    limits = df.filter(F.col("role") == "train").groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    out = df.join(limits, list(keys))

    def unit(c: str) -> Column:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return (F.col(c) - F.col(f"_lo_{c}")) / F.when(width == 0, 1.0).otherwise(width)

    return out.withColumns({c: unit(c) for c in columns}).drop(*[f"_{s}_{c}" for s in ("lo", "hi") for c in columns])


def sequences(df: DataFrame, keys: Sequence[str], columns: Sequence[str], steps: int, include_label_row: bool = False,
              date: str = "date") -> DataFrame:
    """Feature rows of the last ``steps`` rows per (series, walk, role) as ``x``, the row's own label kept.

    By default the window ends one row before the label. ``include_label_row`` lets it end on the label's row, as the
    weekly models of the original do; that leaks the label where a feature contains it.
    """
    w = ordered(keys, date)
    frame = w.rowsBetween(-(steps - 1), 0) if include_label_row else w.rowsBetween(-steps, -1)
    x = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame)
    return df.withColumn("x", x).filter(F.size("x") == steps)


def class_weight(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Negatives over positives on the training rows."""
    return df.filter(F.col("role") == "train").groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).alias("pos_weight"))


def decide(prob="prob", threshold: float = 0.5) -> Column:
    return F.when(F.col(prob) > threshold, 1).otherwise(0)


def classification_metrics(df: DataFrame, keys: Sequence[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Confusion counts and the rates from them, 0 where a rate has no rows."""
    p, a = F.col(pred) == 1, F.col(actual) == 1
    safe = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return (
        df.groupBy(*keys).agg(
            F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"),
            F.count_if(~p & a).alias("fn"))
        .withColumn("accuracy", safe(tp + tn, tp + tn + fp + fn)).withColumn("precision", safe(tp, tp + fp))
        .withColumn("recall", safe(tp, tp + fn))
        .withColumn("f1", safe(2 * tp, 2 * tp + fp + fn))
        .withColumn("specificity", safe(tn, tn + fp)).withColumn("sensitivity", F.col("recall")))


def chronological_split(df: DataFrame, keys: Sequence[str], train: float = 0.6, validation: float = 0.2,
                        date: str = "date") -> DataFrame:
    """Parts by row count, the counts cut to whole rows."""
    i = F.row_number().over(ordered(keys, date)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    part = F.when(i < F.floor(n * F.lit(train)), "train").when(i < F.floor(n * F.lit(train + validation)), "val").otherwise("test")
    return df.withColumn("part", part)


def error_features(df: DataFrame, prob: str = "prob", sentiment: str | None = None, pred: str = "pred") -> DataFrame:
    """Confidence, entropy and uncertainty flags of a probability, and agreement with sentiment where given."""
    p = F.col(prob)
    out = df.withColumns({
        "confidence": F.abs(p - 0.5) * 2,
        "entropy": -(p * F.ln(p + 1e-8) + (1 - p) * F.ln(1 - p + 1e-8)),
        "uncertain": (F.abs(p - 0.5) < 0.1).cast("int"),
        "extreme": ((p > 0.8) | (p < 0.2)).cast("int")})
    if sentiment is None:
        return out
    sign = (F.col(sentiment) > 0).cast("int")
    return out.withColumns({
        "agrees": (sign == F.col(pred)).cast("int"),
        "strong_disagree": ((F.abs(sentiment) > 20) & (sign != F.col(pred))).cast("int"),
        "interaction": p * F.col(sentiment)})


# The inputs of the error model beside those of the prediction itself.
SENTIMENT_INPUTS = (
    "sentiment_supply", "sentiment_demand", "supply_decayed", "demand_decayed", "policy_decayed", "supply_momentum",
    "demand_momentum", "doc_count", "max_policy", "avg_policy")
PREDICTION_INPUTS = ("pred", "prob", "confidence", "entropy", "uncertain", "extreme")
AGREEMENT_INPUTS = ("agrees", "strong_disagree", "interaction")


# Reversal thresholds tried, from 0.40 in steps of 0.05, the greatest reversal share and the default.
THRESHOLDS = tuple(0.4 + 0.05 * i for i in range(8))
MOST_REVERSED = 0.3
DEFAULT_THRESHOLD = 0.6


def threshold_table(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Accuracy after reversal and share reversed at every threshold, from one pass over the rows."""
    kept_right = (F.col("pred") == F.col("actual"))
    aggs = []
    for i, thr in enumerate(thresholds):
        flip = F.col("p_err") > F.lit(thr)
        aggs += [F.avg(F.when(flip != kept_right, 1.0).otherwise(0.0)).alias(f"_a{i}"), F.avg(flip.cast("double")).alias(f"_r{i}")]
    one = df.groupBy(*keys).agg(*aggs)
    return one.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(thr).alias("threshold"), F.col(f"_a{i}").alias("accuracy"), F.col(f"_r{i}").alias("reversal_rate"))
        for i, thr in enumerate(thresholds)])))


def best_threshold(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First threshold of the highest accuracy among those that reverse less than the limit, else the default."""
    allowed = (F.col("reversal_rate") < MOST_REVERSED) & (F.col("accuracy") > 0)
    best = F.max(F.when(allowed, F.struct("accuracy", (-F.col("threshold")).alias("order"))))
    return threshold_table(df, keys).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.coalesce(-F.col("_b.order"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("_b.accuracy"), F.lit(0.0)).alias("accuracy"))


def reverse(df: DataFrame, threshold) -> DataFrame:
    """Flip the prediction where the error probability exceeds the threshold (a number or a column)."""
    flip = F.col("p_err") > threshold
    return df.withColumn("reversed", flip).withColumn("final", F.when(flip, 1 - F.col("pred")).otherwise(F.col("pred")))


def reversal_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy before and after, improvement, share reversed, success of reversed and of kept rows, P/R/F1."""
    right, before = (F.col("final") == F.col("actual")).cast("double"), (F.col("pred") == F.col("actual")).cast("double")
    rev = F.col("reversed")
    base = classification_metrics(df, keys, "final").drop("accuracy", "specificity", "sensitivity", "tp", "tn", "fp", "fn")
    one = df.groupBy(*keys).agg(
        F.avg(before).alias("baseline_accuracy"), F.avg(right).alias("final_accuracy"), F.avg(rev.cast("double")).alias("reversal_rate"),
        F.count_if(rev).alias("reversed_count"), F.count("*").alias("total_samples"),
        F.coalesce(F.avg(F.when(rev, right)), F.lit(0.0)).alias("reversals_correct"), F.avg(F.when(~rev, right)).alias("_kept"))
    kept = F.when(F.col("reversed_count") > 0, F.coalesce("_kept", F.lit(0.0))).otherwise(F.col("baseline_accuracy"))
    return (
        one.withColumn("improvement", F.col("final_accuracy") - F.col("baseline_accuracy")).withColumn("kept_correct", kept)
        .drop("_kept").join(base, list(keys)))


def reversal_buckets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reversals and their success by error probability in [.5,.6), [.6,.7), [.7,.8), [.8,1)."""
    e = F.col("p_err")
    bucket = (
        F.when((e >= 0.5) & (e < 0.6), "0.5-0.6").when((e >= 0.6) & (e < 0.7), "0.6-0.7")
        .when((e >= 0.7) & (e < 0.8), "0.7-0.8").when((e >= 0.8) & (e < 1.0), "0.8-1.0"))
    hits = df.filter("reversed").withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    return hits.groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.avg((F.col("final") == F.col("actual")).cast("double")).alias("success"))


def ensemble(df: DataFrame, keys: Sequence[str] = ("market", "date")) -> DataFrame:
    """Majority of predictions and mean of probabilities over the models."""
    return df.groupBy(*keys).agg(
        F.when(F.avg("pred") > 0.5, 1).otherwise(0).alias("majority"), F.when(F.avg("prob") > 0.5, 1).otherwise(0).alias("average"))


def signal_kinds(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, high: float = 0.7) -> DataFrame:
    """All signal kinds of a prediction in long form: binary, scaled and plain above the threshold, high confidence."""
    p = F.col("prob")
    kinds = {
        "binary": F.col("pred").cast("double"),
        "scaled": F.when(p > threshold, F.abs(p - 0.5) * 2).otherwise(0.0),
        "threshold": F.when(p > threshold, 1.0).otherwise(0.0),
        "confident": F.when(p > high, 1.0).otherwise(0.0)}
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), v.alias("signal")) for k, v in kinds.items()])))


def accuracy_by_confidence(df: DataFrame, keys: Sequence[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Accuracy of confident, other and all rows; an empty band has 0."""
    sure = (F.col("prob") > high) | (F.col("prob") < low)
    right = (F.col("pred") == F.col("actual")).cast("double")
    one = df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(sure, right)), F.lit(0.0)).alias("_high"), F.coalesce(F.avg(F.when(~sure, right)), F.lit(0.0)).alias("_mid"),
        F.avg(right).alias("_all"))
    return one.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"_{b}").alias("accuracy")) for b in ("high", "mid", "all")])))


def walk_aggregate(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], walk: str = "walk", score: str = "f1") -> DataFrame:
    """Mean and population deviation over walks, their number and samples, the best walk by score (first on a tie)."""
    return metrics.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        F.count("*").alias("n_walks"), F.sum("n").alias("total_samples"),
        F.max_by(walk, F.struct(F.col(score), -F.col(walk))).alias("best_walk"))


def walk_trend(metrics: DataFrame, keys: Sequence[str], walk: str = "walk", score: str = "f1", flat: float = 0.001) -> DataFrame:
    slope = F.regr_slope(score, walk)
    return metrics.groupBy(*keys).agg(slope.alias("slope"), F.regr_intercept(score, walk).alias("intercept")).withColumn(
        "trend", F.when(F.col("slope") > flat, "Improving").when(F.col("slope") < -flat, "Declining").otherwise("Stable"))


def mean_curve(df: DataFrame, keys: Sequence[str], curve: str) -> DataFrame:
    """Mean by position over curves of different lengths; positions past an end are left out."""
    return df.select(*keys, F.posexplode(curve).alias("epoch", "value")).groupBy(*keys, "epoch").agg(
        F.avg("value").alias("value"), F.count("value").alias("n"))

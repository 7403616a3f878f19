"""Ridge logistic regression for many keys at once, by Newton steps on added-up Gram matrices.

A step needs per key the weighted Gram matrix of its training rows and the gradient, p(p + 1)/2 + p sums over rows. Tasks add up
the rows they hold, an aggregate adds up the tasks' sums, and each key solves its small system. No key's rows are gathered;
between steps only coefficients travel, which join back to the rows by key. All keys step until the last one stands still.

The first rows of the design are the given columns, standardised by the mean and deviation of the key's training rows; the last is
the constant, which has no penalty to speak of.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.series import ordered
from marketloom.session import settle

RIDGE, CONSTANT_RIDGE, ROUNDS, STILL, LIMIT = 1.0, 1e-6, 25, 1e-8, 30.0


def sequence_summaries(df: DataFrame, keys: Sequence[str], columns: Sequence[str], steps: int, include_label_row: bool = False,
                       date: str = "date") -> tuple[DataFrame, list[str]]:
    """(rows, names): last value, mean and change of each column over the ``steps`` rows of a sequence, from windows alone.

    The sequences are those of ``learning.sequences``: they end one row before the label, or on its row. Rows without a
    whole sequence go.
    """
    w = ordered(list(keys), date)
    end = 0 if include_label_row else 1
    frame = w.rowsBetween(-(steps - 1) - end, -end)
    added: dict[str, Column] = {}
    for c in columns:
        value = F.col(c).cast("double")
        last, first = F.lag(value, end).over(w), F.lag(value, end + steps - 1).over(w)
        added |= {f"{c}_last": last, f"{c}_mean": F.avg(value).over(frame), f"{c}_change": last - first}
    out = df.withColumns({**added, "_place": F.row_number().over(w)}).filter(F.col("_place") >= steps + end).drop("_place")
    order = [f"{c}_{kind}" for kind in ("last", "mean", "change") for c in columns]
    return out, order


def standardised(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], train: Column, out: str = "z") -> DataFrame:
    """Adds ``out``: the columns less their key's training mean, over its deviation (1 where that is 0)."""
    limits = rows.filter(train).groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in columns]).alias("_mu"), F.array(*[F.stddev_pop(c) for c in columns]).alias("_sd"))
    at = lambda name, i: F.get(name, F.lit(i))
    z = [(F.col(c) - at("_mu", i)) / F.when(at("_sd", i) == 0, 1.0).otherwise(at("_sd", i)) for i, c in enumerate(columns)]
    return rows.join(limits, list(keys)).withColumn(out, F.array(*z)).drop("_mu", "_sd")


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key of a task: upper triangle of the Gram matrix and the gradient, without penalty; rows have key, z, y, w, beta."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").dictionary_encode()
        z, beta = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("z", "beta"))
        a = np.hstack([z, np.ones((len(z), 1))])
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        p = 1 / (1 + np.exp(-np.clip((a * beta).sum(1), -LIMIT, LIMIT)))
        slope, curve = w * (y - p), w * p * (1 - p)
        upper = np.triu_indices(a.shape[1])
        of = key.indices.to_numpy()
        for i, name in enumerate(key.dictionary.to_pylist()):
            own = of == i
            gram = (a[own] * curve[own, None]).T @ a[own]
            part = np.concatenate([gram[upper], a[own].T @ slope[own]])
            total[name] = total[name] + part if name in total else part
    names = list(total)
    cells = np.arange(len(total[names[0]])) if names else np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(names, len(cells)) if names else [], pa.string()), pa.array(np.tile(cells, len(names)), pa.int32()),
         pa.array(np.concatenate([total[n] for n in names]) if names else [], pa.float64())], ["key", "cell", "s"])


def fit(rows: DataFrame, keys: Sequence[str], z: str = "z", y: str = "y", weight: str = "weight", ridge: float = RIDGE,
        rounds: int = ROUNDS) -> DataFrame:
    """(keys, beta): coefficients of the standardised columns and the constant, for every key of the training rows."""
    keys = list(keys)
    key = F.to_json(F.struct(*keys)).alias("key")
    data = settle(rows.select(key, F.col(z).alias("z"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")))
    names = settle(rows.select(*keys, key).distinct())
    beta = settle(data.groupBy("key").agg(F.transform(F.concat(F.max("z"), F.array(F.lit(0.0))), lambda _: F.lit(0.0)).alias("beta")))

    def step(table: pa.Table) -> pa.Table:
        s = table["s"].to_numpy()[np.argsort(table["cell"].to_numpy())]
        old = np.array(table["beta"][0].as_py())
        n = len(old)
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = s[: n * (n + 1) // 2]
        penalty = np.diag([ridge] * (n - 1) + [CONSTANT_RIDGE])
        curve = gram + np.triu(gram, 1).T + penalty
        slope = s[n * (n + 1) // 2:] - penalty @ old
        move = np.linalg.solve(curve, slope)
        return pa.table({"key": table["key"].slice(0, 1), "beta": pa.array([old + move], pa.list_(pa.float64())), "move": [np.abs(move).max()]})

    for _ in range(rounds):
        sums = data.join(beta, "key").mapInArrow(_partial_sums, "key string, cell int, s double").groupBy("key", "cell").agg(F.sum("s").alias("s"))
        moved = settle(sums.join(beta, "key").groupBy("key").applyInArrow(step, "key string, beta array<double>, move double"))
        beta = moved.select("key", "beta")
        if (moved.agg(F.max("move")).first()[0] or 0.0) < STILL:
            break
    return names.join(beta, "key").drop("key")


def probability(z: str = "z", beta: str = "beta") -> Column:
    """Probability of 1 for a standardised row and its key's coefficients."""
    n = F.size(z)
    dot = F.aggregate(F.zip_with(F.col(z), F.slice(beta, F.lit(1), n), lambda a, b: a * b), F.get(beta, n), lambda t, x: t + x)
    return 1 / (1 + F.exp(-F.least(F.greatest(dot, F.lit(-LIMIT)), F.lit(LIMIT))))


def walk_probabilities(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date") -> DataFrame:
    """(keys, date, prob, actual): probability of a rise for the test rows of every key, fitted on its training rows.

    ``rows`` has role, y and the columns. Positives carry the ratio of the classes; a key whose training rows are of one class
    has no model and no rows.
    """
    keys = list(keys)
    train = F.col("role") == "train"
    w = Window.partitionBy(*keys)
    # A walk has a fixed number of rows; the sums over it are windows on the partitioning that its columns were made in.
    falls, rises = F.sum(F.when(train & (F.col("y") == 0), 1).otherwise(0)).over(w), F.sum(F.when(train & (F.col("y") == 1), 1).otherwise(0)).over(w)
    held = rows.withColumns({"_falls": falls, "_rises": rises}).filter("_falls > 0 and _rises > 0")
    held = held.withColumn("weight", F.when(F.col("y") == 1, F.col("_falls") / F.col("_rises")).otherwise(1.0)).drop("_falls", "_rises")
    held = settle(standardised(held, keys, columns, train).select(*keys, date, "role", "y", "weight", "z"))
    beta = fit(held.filter(train), keys)
    return held.filter("role = 'test'").join(beta, keys).select(*keys, date, probability().alias("prob"), F.col("y").cast("int").alias("actual"))

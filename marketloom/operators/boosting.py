"""Boosted trees for all keys in one job, grown level by level from histograms.

Every key (a market and frequency, say) has its own ensemble for a 0/1 target under logistic loss. Features are cut into bins at
their key's quantiles once. A level of a tree needs, for each of its nodes, the sums of gradients and curvatures by feature and
bin, and takes the best split off them. A key whose training rows fit a task grows all its trees there; thousands of keys are
tasks of one job. A key with more rows spreads: for each level of all such keys the tasks add up their rows' sums by (key, node,
feature, bin), an aggregate adds up the tasks', and the splits chosen from its bins go back to the tasks. The driver handles the
sums of a bounded number of such keys at a time. Both ways run the same code on the same sums and give the same trees.

Rows and features of a round are sampled by hashes of their identity, so a repeated task sees the same sample. A null feature
counts as its lowest bin. A key without training rows has no trees, and its rows have probability one half.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import settle


@dataclass(frozen=True)
class Settings:
    """Shape of the ensembles. The defaults are the error predictor's: fixed values."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.05
    least_curvature: float = 5.0
    row_share: float = 0.8
    feature_share: float = 0.8
    positive_weight: float = 1.2
    ridge: float = 1.0
    bins: int = 32
    seed: int = 7
    #: Training rows that one task takes, and keys with more rows whose sums the driver holds at a time.
    rows_per_task: int = 50_000
    keys_at_once: int = 64
    #: Rounds whose trees are walked anew before the rows of large keys are written with their value.
    kept_rounds: int = 10


#: A node: feature (-1 for a leaf), last bin of the left side, value of a leaf, and what its split gained.
NODE = "struct<feature:int,cut:int,value:double,gain:double>"


def _same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    named = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)])
    return a.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def bin_bounds(train: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """(keys, bounds): per key and feature the upper ends of its bins, at quantiles, without the last."""
    probs = [i / bins for i in range(1, bins)]
    quantiles = [F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), probs, 10_000))), F.array().cast("array<double>")) for c in features]
    return train.groupBy(*keys).agg(F.array(*quantiles).alias("bounds"))


def binned(df: DataFrame, keys: Sequence[str], features: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Adds ``bins``, per feature the number of its key's bounds below the value."""
    def below(value: Column, ends: Column) -> Column:
        return F.size(F.filter(ends, lambda b: value > b))

    place = [below(F.col(c).cast("double"), F.get("bounds", F.lit(i))) for i, c in enumerate(features)]
    return _same_keys(df, bounds, keys).withColumn("bins", F.when(F.col("bounds").isNotNull(), F.array(*place))).drop("bounds")


def _step(tree: Column, node: Column) -> Column:
    """The child a row goes to, or the node itself if it is a leaf or not split yet."""
    at = F.get(tree, node)
    left = F.get("bins", at["feature"]) <= at["cut"]
    return F.when(at["feature"] >= 0, 2 * node + F.when(left, 1).otherwise(2)).otherwise(node)


def _node(tree: Column, levels: int) -> Column:
    node = F.lit(0)
    for _ in range(levels):
        node = _step(tree, node)
    return node


def _value(trees: str, depth: int) -> Column:
    """Sum of the leaves a row reaches."""
    return F.aggregate(F.coalesce(F.col(trees), F.array().cast(f"array<array<{NODE}>>")), F.lit(0.0), lambda acc, t: acc + F.get(t, _node(t, depth))["value"])


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# --- growing, in numpy ---------------------------------------------------------------------------------------------


def _in_sample(of: np.ndarray, share: float, salt: int) -> np.ndarray:
    """Whether a hash falls into a share of all; another part for each salt."""
    h = of.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(33))) % np.uint64(1 << 20) < np.uint64(share * (1 << 20))


class Tree:
    """Nodes in heap order: feature (-1 for a leaf), last bin of the left side, value of a leaf, gain of the split."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.cut = depth, np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.value, self.gain, self.open = np.zeros(size), np.zeros(size), {0}

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            feature = self.feature[node]
            left = bins[np.arange(len(bins)), np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(feature < 0, node, 2 * node + np.where(left, 1, 2))
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node_of(bins)]

    def rows(self) -> list[tuple[int, int, float, float]]:
        return list(zip(self.feature.tolist(), self.cut.tolist(), self.value.tolist(), self.gain.tolist()))


def features_of(key_hash: int, turn: int, n_features: int, s: Settings) -> np.ndarray:
    """The features a key's tree of a round may split on, at least one."""
    of = np.uint64(key_hash % (1 << 64)) ^ (np.arange(n_features, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    chosen = np.flatnonzero(_in_sample(of, s.feature_share, s.seed * 7919 + 2 * turn + 1))
    return chosen if len(chosen) else np.zeros(1, np.int64)


def sums(bins: np.ndarray, y: np.ndarray, f: np.ndarray, u: np.ndarray, tree: Tree, turn: int, s: Settings) -> np.ndarray:
    """Gradients and curvatures of the sampled rows by (node, feature, bin)."""
    n_nodes, n_features = len(tree.feature), bins.shape[1]
    taken = _in_sample(u, s.row_share, s.seed * 104_729 + 2 * turn)
    bins, y, f = bins[taken], y[taken], f[taken]
    p, w = 1 / (1 + np.exp(-f)), np.where(y == 1, s.positive_weight, 1.0)
    cell = ((tree.node_of(bins)[:, None] * n_features + np.arange(n_features)) * s.bins + bins).ravel()
    size = n_nodes * n_features * s.bins
    both = [np.bincount(cell, weights=np.repeat(x, n_features), minlength=size) for x in (w * (p - y), w * p * (1 - p))]
    return np.stack(both).reshape(2, n_nodes, n_features, s.bins)


def split(tree: Tree, total: np.ndarray, features: np.ndarray, level: int, s: Settings) -> None:
    """Splits the open nodes of a tree from the sums of its rows, or closes them."""
    for node in sorted(tree.open):
        tree.open.discard(node)
        g, h = total[0, node], total[1, node]
        G, H = g[0].sum(), h[0].sum()
        left_g, left_h = g[features].cumsum(1), h[features].cumsum(1)
        rest_g, rest_h = G - left_g, H - left_h
        gain = left_g**2 / (left_h + s.ridge) + rest_g**2 / (rest_h + s.ridge) - G**2 / (H + s.ridge)
        gain[(left_h < s.least_curvature) | (rest_h < s.least_curvature)] = -np.inf
        # Gains that differ by rounding alone are equal: the first feature and bin of them splits.
        best = gain.max()
        if not best > 1e-9:
            tree.value[node] = -s.rate * G / (H + s.ridge)
            continue
        at, cut = divmod(int(np.flatnonzero(gain.ravel() >= best - 1e-9 * abs(best))[0]), gain.shape[1])
        tree.feature[node], tree.cut[node], tree.gain[node] = features[at], cut, gain[at, cut]
        for child, cg, ch in ((2 * node + 1, left_g[at, cut], left_h[at, cut]), (2 * node + 2, rest_g[at, cut], rest_h[at, cut])):
            tree.value[child] = -s.rate * cg / (ch + s.ridge)
            if level + 1 < s.depth:
                tree.open.add(child)


def _arrays(table, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = table["bins"].combine_chunks() if isinstance(table, pa.Table) else table.column("bins")
    y, f, u = (np.asarray(table[c]) if isinstance(table, pa.Table) else table.column(c).to_numpy() for c in ("y", "f", "u"))
    return bins.flatten().to_numpy().astype(np.int64).reshape(-1, n_features), y, f, u


def _grown_whole(table: pa.Table, key_hash: int, n_features: int, s: Settings) -> list[list]:
    """All trees of a key whose rows are here."""
    bins, y, f, u = _arrays(table, n_features)
    order = np.argsort(u, kind="stable")  # sums do not depend on the order rows came in
    bins, y, f, u = bins[order], y[order], f[order].copy(), u[order]
    trees = []
    for turn in range(s.rounds):
        tree, features = Tree(s.depth), features_of(key_hash, turn, n_features, s)
        for level in range(s.depth):
            if tree.open:
                split(tree, sums(bins, y, f, u, tree, turn, s), features, level, s)
        f += tree.values(bins)
        trees.append(tree.rows())
    return trees


def _grown_spread(rows: DataFrame, hashes: list[int], n_features: int, s: Settings) -> list[list[list]]:
    """Trees of several keys (``k`` counts them) whose rows spread over tasks; rows have k, y, bins, u and f."""
    size = (2 ** (s.depth + 1) - 1) * n_features * s.bins
    grown: list[list[Tree]] = [[] for _ in hashes]
    kept = 0

    def values(k: np.ndarray, bins: np.ndarray, f: np.ndarray, recent: list[list[Tree]]) -> np.ndarray:
        f = f.copy()
        for i in np.unique(k).tolist():
            mine = k == i
            for tree in recent[i]:
                f[mine] += tree.values(bins[mine])
        return f

    for turn in range(s.rounds):
        current = [Tree(s.depth) for _ in hashes]
        recent = [trees[kept:] for trees in grown]
        for level in range(s.depth):
            if not any(t.open for t in current):
                break

            def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    k = batch.column("k").to_numpy()
                    bins, y, f, u = _arrays(batch, n_features)
                    f = values(k, bins, f, recent)
                    for i in np.unique(k).tolist():
                        mine = k == i
                        part = sums(bins[mine], y[mine], f[mine], u[mine], current[i], turn, s)
                        total[i] = total[i] + part if i in total else part
                for i, part in total.items():
                    g, h = part.reshape(2, -1)
                    cells = np.flatnonzero((g != 0) | (h != 0))
                    yield pa.RecordBatch.from_arrays([pa.array(cells + i * size), pa.array(g[cells]), pa.array(h[cells])], ["cell", "g", "h"])

            cells = rows.mapInArrow(add_up, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # keys_at_once times cells of a tree
            total = np.zeros((2, len(hashes) * size))
            at = cells["cell"].to_numpy()
            total[0, at], total[1, at] = cells["g"].to_numpy(), cells["h"].to_numpy()
            for i, tree in enumerate(current):
                own = total[:, i * size:(i + 1) * size].reshape(2, -1, n_features, s.bins)
                split(tree, own, features_of(hashes[i], turn, n_features, s), level, s)
        for trees, tree in zip(grown, current):
            trees.append(tree)
        if turn + 1 - kept == s.kept_rounds and turn + 1 < s.rounds:
            recent = [trees[kept:] for trees in grown]

            def move_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins, _, f, _ = _arrays(batch, n_features)
                    moved = values(batch.column("k").to_numpy(), bins, f, recent)
                    yield batch.set_column(batch.schema.get_field_index("f"), "f", pa.array(moved))

            rows = settle(rows.mapInArrow(move_on, rows.schema))
            kept = turn + 1
    return [[tree.rows() for tree in trees] for trees in grown]


def fit(train: DataFrame, keys: Sequence[str], identity: Sequence[str], features: Sequence[str], target: str,
        settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(bounds, model): bin ends, and (keys, trees) with all trees of each key.

    ``identity`` names the columns that tell a key's rows apart; sampling depends on them.
    """
    s, keys, spark, n_features = settings, list(keys), train.sparkSession, len(features)
    used = train.filter(F.col(target).isNotNull())
    bounds = settle(bin_bounds(used, keys, features, s.bins))
    counted = used.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = _same_keys(binned(used, keys, features, bounds), counted, keys).select(
        *keys, F.col(target).cast("double").alias("y"), "bins", F.xxhash64(*keys, *identity).alias("u"), F.lit(0.0).alias("f"),
        F.xxhash64(*keys, F.lit(0)).alias("key_hash"), F.col("_n").alias("n"))
    rows = settle(rows)
    kinds = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)
    kind = f"{kinds}, trees array<array<{NODE}>>"
    node_type = pa.struct([("feature", pa.int32()), ("cut", pa.int32()), ("value", pa.float64()), ("gain", pa.float64())])

    def whole(table: pa.Table) -> pa.Table:
        trees = _grown_whole(table, table["key_hash"][0].as_py(), n_features, s)
        named = [[dict(zip(("feature", "cut", "value", "gain"), n)) for n in tree] for tree in trees]
        return table.select(keys).slice(0, 1).append_column("trees", pa.array([named], pa.list_(pa.list_(node_type))))

    model = rows.filter(F.col("n") <= s.rows_per_task).groupBy(*keys).applyInArrow(whole, kind)
    large = rows.filter(F.col("n") > s.rows_per_task).select(*keys, "key_hash").distinct().collect()  # at most rows / rows_per_task
    for at in range(0, len(large), s.keys_at_once):
        part = large[at: at + s.keys_at_once]
        numbers = spark.createDataFrame([(*r, i) for i, r in enumerate(part)], f"{kinds}, key_hash long, _number int")
        own = _same_keys(rows.filter(F.col("n") > s.rows_per_task).drop("key_hash"), numbers.drop("key_hash"), keys).filter("_number is not null")
        trees = _grown_spread(settle(own.select(F.col("_number").alias("k"), "y", "bins", "u", "f")), [r.key_hash for r in part], n_features, s)
        model = model.union(spark.createDataFrame([(*r[: len(keys)], t) for r, t in zip(part, trees)], kind))
    return bounds, settle(model)


def probabilities(df: DataFrame, keys: Sequence[str], features: Sequence[str], model: tuple[DataFrame, DataFrame], settings: Settings = Settings(),
                  out: str = "p_err") -> DataFrame:
    """Adds the probability that the target is 1."""
    bounds, trees = model
    walked = _same_keys(binned(df, keys, features, bounds), trees, keys)
    return walked.withColumn(out, _sigmoid(_value("trees", settings.depth))).drop("trees", "bins")


def importances(model: tuple[DataFrame, DataFrame], keys: Sequence[str], features: Sequence[str], most: int | None = 10) -> DataFrame:
    """(keys, rank, feature, importance, splits): mean gain of a feature's splits, as shares that add up to 1 per key."""
    nodes = model[1].select(*keys, F.explode(F.flatten("trees")).alias("n")).filter("n.feature >= 0")
    names = F.array(*[F.lit(f) for f in features])
    gains = nodes.groupBy(*keys, F.get(names, F.col("n.feature")).alias("feature")).agg(F.avg("n.gain").alias("gain"), F.count("*").alias("splits"))
    total = gains.groupBy(*keys).agg(F.sum("gain").alias("total"))
    shares = _same_keys(gains, total, keys).select(*keys, "feature", (F.col("gain") / F.col("total")).alias("importance"), "splits")
    from marketloom.operators.ordering import top_per_key

    return top_per_key(shares, keys, [F.desc("importance"), F.asc("feature")], most or len(features))

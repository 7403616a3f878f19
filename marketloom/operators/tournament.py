"""Best of many by pairwise judgement, in bracket rounds.

Candidates of a group stand in order; in each round neighbours meet, a judge decides every pair of all groups in one job, and
winners take the pair's place, so rounds grow with the logarithm of the largest group and each candidate loses once at most.
Places come from a range partition, pairs from an aggregate of two rows, so no group gathers in a task. A winner carries whom it
beat: the second best must be among these, at most one per round, and is found by a bracket over them alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ordering import positions
from marketloom.session import settle

#: Adds ``first_wins`` to rows of the keys and two structs, ``a`` and ``b``.
Judge = Callable[[DataFrame], DataFrame]


def by_score(column: str = "score") -> Judge:
    """The higher score wins, the first on a tie."""
    return lambda met: met.withColumn("first_wins", F.col(f"a.{column}") >= F.col(f"b.{column}"))


def compared_by(compare: Callable[[dict, dict, dict], bool]) -> Judge:
    """Hook for any judge of two candidates: called inside tasks with the keys and both, true if the first wins."""
    def judge(met: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                wins = [bool(compare({k: v for k, v in r.items() if k not in ("a", "b")}, r["a"], r["b"])) for r in rows]
                yield batch.append_column("first_wins", pa.array(wins, pa.bool_()))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields)
        return met.mapInArrow(run, f"{kinds}, first_wins boolean")

    return judge


def bracket(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], judge: Judge) -> DataFrame:
    """(keys, won, beaten): per group the winner as a struct of the other columns, and those it beat, the last first."""
    keys = list(keys)
    rest = [c for c in candidates.columns if c not in keys]
    kind = F.struct(*rest)
    state = positions(candidates, keys, list(order), "_at")
    none = F.array().cast(f"array<{candidates.select(kind.alias('s')).schema['s'].dataType.simpleString()}>")
    state = settle(state.select(*keys, (F.col("_at") - 1).alias("_place"), kind.alias("won"), none.alias("beaten")))
    side = lambda n: F.any_value(F.when(F.col("_place") % 2 == n, F.struct("won", "beaten")), F.lit(True))
    while state.filter("_place > 0").limit(1).count():
        pairs = state.groupBy(*keys, F.floor(F.col("_place") / 2).alias("_place")).agg(side(0).alias("_x"), side(1).alias("_y"))
        lone = pairs.filter("_y IS NULL").select(*keys, "_place", "_x.won", "_x.beaten")
        met = pairs.filter("_y IS NOT NULL").select(*keys, "_place", F.col("_x.won").alias("a"), F.col("_y.won").alias("b"), F.col("_x.beaten").alias("_a"), F.col("_y.beaten").alias("_b"))
        judged = judge(met)
        pick = lambda one, two: F.when(F.col("first_wins"), F.col(one)).otherwise(F.col(two))
        decided = judged.select(*keys, "_place", pick("a", "b").alias("won"), F.concat(F.array(pick("b", "a")), pick("_a", "_b")).alias("beaten"))
        state = settle(decided.unionByName(lone))
    return state.drop("_place")


def best_two(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], judge: Judge) -> DataFrame:
    """(keys, other columns, rank): the best of each group and, where there is one, the second best."""
    keys = list(keys)
    first = bracket(candidates, keys, order, judge)
    second = bracket(first.select(*keys, F.inline("beaten")), keys, order, judge)
    top = first.select(*keys, "won.*", F.lit(1).alias("rank"))
    return top.unionByName(second.select(*keys, "won.*", F.lit(2).alias("rank")))

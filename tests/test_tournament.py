"""Bracket rounds: any judge, ties, the second best, and slots filled by them."""

import random

from pyspark.sql import functions as F

from marketloom.operators import slots, tournament
from marketloom.operators.ordering import top_per_key


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [("g0" if i % 3 else f"g{rng.randint(1, 9)}", i, float(rng.randint(0, 20))) for i in range(n)]


def test_score_judge_equals_the_order_by_score(spark):
    df = spark.createDataFrame(rows_of(400) + [("one", 999, 1.0)], "g string, doc_id long, score double").repartition(7)
    want = {(r.g, r["rank"]): (r.doc_id, r.score) for r in top_per_key(df, ["g"], [F.desc("score"), F.asc("doc_id")], 2).collect()}
    for judge in (tournament.by_score(), tournament.compared_by(lambda key, a, b: a["score"] >= b["score"])):
        got = {(r.g, r["rank"]): (r.doc_id, r.score) for r in tournament.best_two(df, ["g"], ["doc_id"], judge).collect()}
        assert got == want


def test_judge_sees_each_candidate_lose_once_and_first_wins_ties(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(37)], "g string, doc_id long, score double")
    won = tournament.bracket(df, ["g"], ["doc_id"], tournament.by_score()).first()
    assert won.won.doc_id == 0 and len(won.beaten) == 6  # 37 in six rounds
    odd = tournament.compared_by(lambda key, a, b: a["doc_id"] % 5 > b["doc_id"] % 5)
    assert tournament.bracket(df, ["g"], ["doc_id"], odd).first().won.doc_id % 5 == 4
    assert tournament.bracket(df.limit(0), ["g"], ["doc_id"], odd).count() == 0


def test_runner_up_fills_the_inner_slot(spark):
    docs = [(1, -90.0, 0.0, 0.0), (2, -80.0, 0.0, 0.0), (3, -99.0, 0.0, 0.0)]
    c = slots.classify(spark.createDataFrame(docs, "doc_id long, supply double, demand double, strength double"))
    for judge in (None, tournament.by_score()):
        got = {(r.dimension, r.category): (r.doc_id, r.status, r.adapted) for r in slots.merged_slots(c, judge).collect()}
        assert len(got) == 12 and got["supply", "restrict"] == (3, "filled", False) and got["supply", "reduce"] == (1, "filled", True)
        assert got["demand", "increase"] == (1, "filled", False) and got["demand", "reduce"] == (None, "empty", False)

"""Pairs of few keys with many rows, and what is built on them."""

import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tidepool.operators import products, search
from tidepool.plans import aggregates, registry, relational  # noqa: F401


def streamed(df):
    """Whether pairs are made after the last shuffle and go straight to the result."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    made = plan.index("Generate inline(")
    return not any(x in plan[:made] for x in ("Aggregate", "Join", "Repartition", "Window", "Sort"))


@pytest.mark.parametrize("pack", [1, 3, 1000])
def test_pairs_of_a_key(spark, pack):
    rng = random.Random(pack)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    left, right = [(key(), i, [i]) for i in range(60)], [(key(), i) for i in range(50)]
    got = products.paired(spark.createDataFrame(left, "k string, i int, of array<int>"), spark.createDataFrame(right, "k string, j int"), "k", pack)
    assert got.columns == ["i", "of", "j"] and streamed(got)
    assert sorted((r["i"], r["of"][0], r["j"]) for r in got.collect()) == sorted((i, i, j) for k, i, _ in left for h, j in right if k is not None and k == h)


def test_recipients_are_each_once(spark):
    """Two alerts of one user that match, a follower whose alert matches too, a campaign of two venues and repeated rows."""
    campaigns = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 2), (3, 9)], "campaign_id long, venue_id long")
    follows = spark.createDataFrame([(1, 1, True), (2, 7, True), (2, 7, True), (2, 8, False), (9, 7, True)], "venue_id long, user_id long, promotion boolean")
    alert = lambda i, user, place, query="", active=True: (i, user, place, "", "", [], query, active, ["promotion"])
    alerts = spark.createDataFrame([alert(1, 1, "N"), alert(2, 1, ""), alert(3, 2, "S"), alert(4, 3, "S", active=False), alert(5, 4, "N", None), alert(6, 7, "S")], "alert_id long, user_id long, neighborhood string, deal_type string, feature string, days array<string>, query string, active boolean, kinds array<string>")
    venues = spark.createDataFrame([(1, "One", "N", ["Monday"], ["food"], [], "", 1), (2, "Two", "S", ["Monday"], [], [], "", 2)], "venue_id long, name string, neighborhood string, days array<string>, deal_types array<string>, features array<string>, vibe string, ordinal long")
    got = sorted(map(tuple, search.recipients(campaigns, follows, alerts, venues).collect()))
    assert got == [(1, 1), (1, 2), (1, 7), (2, 1), (2, 2), (2, 7), (3, 7)]
    firsts = sorted(map(tuple, search.unions(alerts.where("active"), venues).collect()))
    assert firsts == [(1, 1, 1), (1, 2, 2), (2, 2, 3), (7, 2, 6)]


def test_recipients_make_no_pair_before_the_last_shuffle(spark):
    """What is shuffled is of the size of the tables, not of the result."""
    found = registry.QUERIES["join_follow_recipients"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Generate inline(" in plan


def test_unions_make_no_pair_before_the_last_shuffle(spark):
    assert streamed(registry.QUERIES["agg_set_union_matches"](spark, SF))


def test_cells_are_small_and_lean(spark):
    rows = spark.range(5000).selectExpr("'hot' AS k", "id AS i")
    assert products.packed(rows, "k", "p").selectExpr("max(size(p)) AS n").first()["n"] < 700
    plan = registry.QUERIES["join_theta_alert_venue"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_left" in plan and "created_at" not in plan and "venue_ordinal" not in plan.split("Generate inline(")[1].split("LocalRelation")[0].split("parquet")[0]


def test_a_cell_is_not_made_by_one_generated_loop(spark):
    """Spark holds what such a loop makes of one row; that must be a row's pairs, not those of a whole cell."""
    rows = spark.range(2000).selectExpr("'hot' AS k", "id AS i")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = products.paired(rows, rows.withColumnRenamed("i", "j"), "k")
        plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    inner, outer = [line for line in plan if "Generate inline" in line]
    assert "*(" in inner and "*(" not in outer
    assert pairs.count() == 4_000_000

"""Joins by cells and grams against all pairs."""

import math
import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tidepool.operators import nearby, search
from tidepool.sources.domain import Domain


def distance(a, b):
    (y, x), (v, u) = a, b
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 3958.7613 * math.asin(min(1, math.sqrt(h)))


def spots(rng, n):
    """Points everywhere, in a town, on both sides of the date line and at the poles."""
    make = [
        lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)), lambda: (32.7 + rng.gauss(0, 0.05), -117.1 + rng.gauss(0, 0.05)), lambda: (rng.uniform(-20, 20), rng.choice([-180, 180, 179.99, -179.99, rng.uniform(179, 180), rng.uniform(-180, -179)])),
        lambda: (rng.choice([90, -90, rng.uniform(89, 90), rng.uniform(-90, -89)]), rng.uniform(-180, 180)), lambda: (0.0, 0.0),
    ]
    return [rng.choice(make)() for _ in range(n)]


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    points, places = spots(rng, 250), spots(rng, 300)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)] + [(900, 91.0, 0.0), (901, None, 3.0), (902, math.nan, 0.0)], "id long, lat double, lng double")
    v = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(places)] + [(900, 0.0, 181.0)], "venue_id long, lat double, lng double")
    return points, places, p, v


@pytest.mark.parametrize("miles", [0, 0.5, 40, 700, 6000, 13000])
def test_radius_joins(both, miles):
    points, places, p, v = both
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(places) if distance(a, b) <= miles}
    got = [tuple(r) for r in nearby.within(p, v, miles).select("id", "venue_id").collect()]
    assert len(got) == len(set(got)) and set(got) ^ want <= {(i, j) for i, j in set(got) ^ want if abs(distance(points[i], places[j]) - miles) < 1e-6}


@pytest.mark.parametrize("k", [1, 7, 400])
def test_nearest_of_many(both, k):
    points, places, p, v = both
    got = {}
    for r in nearby.nearest(p, v, "id", k).orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append(r["distance"])
    assert set(got) == set(range(len(points)))
    for i, a in enumerate(points):
        want = sorted(distance(a, b) for b in places)[:k]
        assert got[i] == pytest.approx(want, abs=2e-6)


def test_a_dense_town_meets_few_places(spark):
    """Candidates of the nearest ten stay in proportion to ten, not to the town's places."""
    rng = random.Random(4)
    places = spark.createDataFrame([(i, 32.7 + rng.gauss(0, 0.02), -117.1 + rng.gauss(0, 0.02)) for i in range(20_000)], "venue_id long, lat double, lng double")
    points = spark.createDataFrame([(i, 32.7 + rng.gauss(0, 0.02), -117.1 + rng.gauss(0, 0.02)) for i in range(50)], "id long, lat double, lng double")
    met = []
    smallest = nearby.smallest
    try:
        nearby.smallest = lambda df, *a, **k: met.append(df.count()) or smallest(df, *a, **k)
        assert nearby.nearest(points, places, "id", 10).count() == 500
    finally:
        nearby.smallest = smallest
    assert met[0] < 50 * 10 * 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_smallest_keeps_few_rows_of_a_key(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("key"), (F.col("id") * 7919 % 50_000).alias("v"))
    got = nearby.smallest(rows, ["key"], [F.col("v")], 4)
    assert plan(got).count("WindowGroupLimit") == 2
    want = {}
    for r in rows.collect():
        want.setdefault(r["key"], []).append(r["v"])
    have = {}
    for r in got.orderBy("key", "nth").collect():
        have.setdefault(r["key"], []).append(r["v"])
    assert have == {k: sorted(x)[:4] for k, x in want.items()}


def test_alerts_without_a_place_meet_venues_by_their_text(spark):
    d = Domain(spark, SF)
    rng = random.Random(2)
    venues = [(i, "".join(rng.choice("abcdefgh ") for _ in range(30)), rng.choice(["North", "South"]), ["Monday"], ["food"], [], rng.choice(["", "wine bar"]), i) for i in range(3000)]
    v = spark.createDataFrame(venues, "venue_id long, name string, neighborhood string, days array<string>, deal_types array<string>, features array<string>, vibe string, ordinal long")
    texts = ["", "a", "ab", "Wine", "ORTH", "abc", "cafe", "hgfed", "zz", "north wine", " "] + [venues[i * 30][1][3:15] for i in range(60)]
    alerts = [(i, "", "", "", rng.choice([[], [], ["Monday"], ["Friday"]]), q) for i, q in enumerate(texts)]
    a = spark.createDataFrame(alerts, "alert_id long, neighborhood string, deal_type string, feature string, days array<string>, query string")
    hay = [f"{x[1]} {x[2]} {x[6]}".lower() for x in venues]
    want = {(i, j) for i, *_, days, q in alerts for j, h in enumerate(hay) if q.lower() in h and (not days or "Monday" in days)}
    found = search.matches(a, v)
    assert {(r["alert_id"], r["venue_id"]) for r in found.collect()} == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    asked = a.where("length(query) > 3").select(*search.FILTERS).distinct()
    met = search.by_text(asked, v.withColumn("v_text", search.haystack("name", "neighborhood", "vibe"))).count()
    assert met < asked.count() * len(venues) / 8
    counts = {r["alert_id"]: (r["n"], r["first"]) for r in search.match_counts(a, v).collect()}
    assert counts == {i: (len(js), sorted(js)[:12]) for i in {i for i, _ in want} if (js := [j for k, j in want if k == i])}
    assert "NestedLoop" not in plan(search.matches(d.alerts(), d.venues()))


def test_equal_coordinates_meet_once(spark):
    """Many points and places on few spots: right pairs, no broadcast of either, and few candidates for each point."""
    p = spark.range(400).select("id", (32.0 + F.col("id") % 4 * 0.01).alias("lat"), F.lit(-117.0).alias("lng"))
    v = spark.range(300).select(F.col("id").alias("venue_id"), (32.0 + F.col("id") % 3 * 0.01).alias("lat"), F.lit(-117.0).alias("lng"))
    got = nearby.nearest(p, v, "id", 2)
    on = {i: [j for j in range(300) if j % 3 == min(i % 4, 2)][:2] for i in range(400)}
    have = {}
    for r in got.orderBy("id", "nth").collect():
        have.setdefault(r["id"], []).append(r["venue_id"])
    assert have == on
    assert plan(got).count("BroadcastHashJoin") <= 1
    near = nearby.within(p, v, 0.1)
    assert sorted((r["id"], r["venue_id"]) for r in near.collect()) == [(i, j) for i in range(400) for j in range(300) if i % 4 == j % 3]
    assert plan(near).index("Generate inline(") < plan(near).index("SortMergeJoin")

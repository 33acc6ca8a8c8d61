import random
import statistics
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pitlake.operators import asof, cohort, events, ranks, series

D0 = date(2024, 1, 1)


def points(spark, values, name="s"):
    return spark.createDataFrame([(name, D0 + timedelta(i), float(v)) for i, v in enumerate(values)], "series string, obs_date date, value double")


def only(df):
    return df.first()["value"]


def test_return_needs_n_plus_one_points(spark):
    assert only(series.trailing_return(points(spark, range(1, 21)), 20, ["series"])) is None
    assert only(series.trailing_return(points(spark, range(1, 22)), 20, ["series"])) == pytest.approx(2000.0)
    assert only(series.trailing_return(points(spark, [0] + [5] * 20), 20, ["series"])) is None


def test_volatility_against_statistics_and_zero_guard(spark):
    random.seed(1)
    values = [100 + random.random() * 10 for _ in range(40)]
    steps = [b / a - 1 for a, b in zip(values[-21:], values[-20:], strict=False)]
    assert only(series.trailing_volatility(points(spark, values), 20, ["series"])) == pytest.approx(statistics.stdev(steps) * 100)
    values[-5] = 0
    assert only(series.trailing_volatility(points(spark, values), 20, ["series"])) is None


def brute_drawdown(values):
    peak, worst = values[0], 0.0
    for v in values:
        peak = max(peak, v)
        if peak > 0:
            worst = min(worst, (v / peak - 1) * 100)
    return worst


def test_drawdown_needs_n_points_and_matches_a_loop(spark):
    random.seed(2)
    values = [random.uniform(50, 150) for _ in range(90)]
    assert only(series.trailing_max_drawdown(points(spark, values), 60, ["series"])) == pytest.approx(brute_drawdown(values[-60:]))
    assert only(series.trailing_max_drawdown(points(spark, values[:60]), 60, ["series"])) is not None
    assert only(series.trailing_max_drawdown(points(spark, values[:59]), 60, ["series"])) is None


def test_rolling_features_equal_trailing_at_each_date(spark):
    random.seed(3)
    values = [random.uniform(50, 150) for _ in range(130)]
    rolled = {r["obs_date"]: r for r in series.rolling_features(points(spark, values), ["series"]).collect()}
    for cut in (20, 59, 60, 121, 130):
        got, part = rolled[D0 + timedelta(cut - 1)], points(spark, values[:cut])
        for name, fn, n in (("return_20d", series.trailing_return, 20), ("volatility_20d", series.trailing_volatility, 20),
                            ("max_drawdown_60d", series.trailing_max_drawdown, 60), ("return_120d", series.trailing_return, 120)):
            want = only(fn(part, n, ["series"]))
            assert got[name] == (None if want is None else pytest.approx(want))


def test_yoy_matches_by_month_not_by_offset(spark):
    data = [("s", date(2023, 3, 1), 100.0), ("s", date(2023, 5, 1), 1.0), ("s", date(2024, 3, 1), 110.0)]
    df = spark.createDataFrame(data, "series string, obs_date date, value double")
    assert only(series.yoy_by_month(df, ["series"])) == pytest.approx(10.0)
    assert only(series.yoy_by_month(df.where("value <> 100"), ["series"])) is None


def test_spread_dates_and_codes(spark):
    a = spark.createDataFrame([(date(2024, 3, 1), 50.0, ["B"])], "as_of_date date, value double, source_codes array<string>")
    b = spark.createDataFrame([(date(2024, 4, 1), 60.0, ["A", "B"])], a.schema)
    assert rows(series.spread(a, b)) == [(date(2024, 4, 1), -10.0, ["A", "B"])]


def test_as_of_join_against_a_loop(spark):
    random.seed(4)
    left = [(i, random.choice("ab"), D0 + timedelta(random.randrange(200))) for i in range(120)]
    right = [(random.choice("ab"), D0 + timedelta(random.randrange(200)), i) for i in range(80)]
    ldf = spark.createDataFrame(left, "id int, k string, t date")
    rdf = spark.createDataFrame(right, "k string, u date, v int")
    for strict in (False, True):
        got = {r["id"]: r["matched_at"] for r in asof.as_of_join(ldf, rdf, ["k"], "t", "u", ["v"], strict=strict).collect()}
        for i, k, t in left:
            before = [u for kk, u, _ in right if kk == k and (u < t if strict else u <= t)]
            assert got[i] == max(before, default=None)
        assert len(got) == len(left)


def prices(spark, closes, entity="e"):
    return spark.createDataFrame([(entity, D0 + timedelta(i), float(c)) for i, c in enumerate(closes)], "entity_id string, obs_date date, close double")


def metrics(spark, closes, offer):
    anchors = spark.createDataFrame([("e", offer, D0)], "entity_id string, offer_price double, start_date date")
    return events.event_metrics(events.first_sessions(events.sessions_from_start(prices(spark, closes), anchors), 60)).first()


def test_event_metrics_are_anchored_at_the_offer(spark):
    random.seed(5)
    closes = [random.uniform(5, 15) for _ in range(60)]
    got = metrics(spark, closes, 10.0)
    for name, n in events.HORIZONS.items():
        assert got[f"return_{name}"] == pytest.approx((closes[n - 1] / 10 - 1) * 100)
        assert got[f"max_drawdown_{name}"] == pytest.approx(brute_drawdown([10.0, *closes[:n]]))


def test_event_metrics_need_n_sessions_and_an_offer(spark):
    assert metrics(spark, [11.0] * 4, 10.0)["return_5d"] is None
    assert metrics(spark, [11.0] * 5, 10.0)["return_5d"] == pytest.approx(10.0)
    for offer in (None, 0.0):
        got = metrics(spark, [11.0] * 5, offer)
        assert got["return_5d"] is None and got["max_drawdown_5d"] is None


def test_outcome_keeps_unresolved_anchor_and_needs_exact_index_date(spark):
    anchors = spark.createDataFrame([("e", 10.0, D0), ("none", 10.0, None)], "entity_id string, offer_price double, start_date date")
    index = spark.createDataFrame([(D0 - timedelta(3), 100.0), (D0, 110.0)], "obs_date date, value double")
    said = spark.createDataFrame([("e", D0), ("e", D0), ("e", D0 - timedelta(1))], "entity_id string, announced_on date")
    out = {r["entity_id"]: r for r in events.build_outcomes(anchors, prices(spark, [11.0] * 6), index, announcements=said).collect()}
    assert out["none"]["price_observation_count"] == 0 and out["none"]["return_1d"] is None
    assert out["e"]["relative_1d"] == pytest.approx(10.0 - 10.0)
    assert out["e"]["relative_5d"] is None
    assert out["e"]["announcement_dates"] == [D0 - timedelta(1), D0]


def test_price_window_ends_at_lookahead_or_reference(spark):
    anchors = spark.createDataFrame([("e", 10.0, D0)], "entity_id string, offer_price double, start_date date")
    far = prices(spark, [1.0] * 150)
    assert events.sessions_from_start(far, anchors).count() == 101
    assert events.sessions_from_start(far, anchors, D0 + timedelta(9)).count() == 10


def test_order_statistics_with_heavy_ties(spark):
    random.seed(6)
    data = [(g, float(random.choice([1, 1, 1, 2, random.randrange(1000)]))) for g in "xy" for _ in range(501)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in ranks.order_statistics(df, ["g"], "v", {"lo": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "out": F.col("n") + 1},
                                                    {"big": F.col("v") > 1}).collect()}
    for g in "xy":
        ordered = sorted(v for k, v in data if k == g)
        assert (got[g]["n"], got[g]["lo"], got[g]["mid"], got[g]["out"]) == (501, ordered[0], ordered[250], None)
        assert got[g]["big"] == sum(v > 1 for v in ordered)


def cohort_case(spark, starts, returns, as_of, target="T"):
    outcomes = spark.createDataFrame(
        [(f"c{i}" if i else "t", s, r, None if r is None else r * 2) for i, (s, r) in enumerate(zip(starts, returns, strict=True))],
        "entity_id string, start_date date, relative_5d double, return_5d double")
    targets = spark.createDataFrame([(target, as_of)], "target_id string, as_of date")
    return targets, outcomes


def test_cohort_clauses(spark):
    as_of = date(2024, 6, 1)
    ok = [as_of - timedelta(d) for d in (9, 30, 90)]
    out = [as_of - timedelta(8), as_of - timedelta(91), as_of, None]
    starts = [as_of - timedelta(40), *ok, *out, as_of - timedelta(20)]
    returns = [99.0, 1.0, 2.0, -3.0, 50.0, 50.0, 50.0, 50.0, None]
    got = cohort.cohort_regime(*cohort_case(spark, starts, returns, as_of), "relative_5d").first()
    assert (got["mature_count"], got["median_return"], got["status"]) == (3, 1.0, "FAVORABLE")


def test_small_cohort_is_unknown_and_share_bounds_are_inclusive(spark):
    as_of = date(2024, 6, 1)
    day = as_of - timedelta(20)
    got = cohort.cohort_regime(*cohort_case(spark, [day] * 3, [9.0, 1.0, 2.0], as_of), "relative_5d").first()
    assert (got["status"], got["mature_count"], got["median_return"]) == ("UNKNOWN", 2, None)
    for positives, status in ((11, "FAVORABLE"), (9, "UNFAVORABLE"), (10, "NEUTRAL")):
        returns = [5.0] + [1.0] * positives + [-1.0] * (20 - positives)
        got = cohort.cohort_regime(*cohort_case(spark, [day] * 21, returns, as_of), "relative_5d").first()
        assert (got["mature_count"], got["status"]) == (20, status)


def test_cohort_median_without_own_against_a_loop(spark):
    random.seed(7)
    as_of = date(2024, 6, 1)
    for size in (1, 2, 3, 4, 7, 8):
        returns = [float(random.randrange(4)) for _ in range(size)]
        case = cohort_case(spark, [as_of - timedelta(20)] * size, returns, as_of)
        got = cohort.cohort_observation(*case, "return_5d", maturity="relative_5d").first()
        others = [r * 2 for r in returns[1:]]
        assert got["comparable_count"] == len(others)
        if others:
            assert got["observed_median"] == pytest.approx(statistics.median(others) / 100)
            assert (got["observed_worst"], got["observed_best"]) == (min(others) / 100, max(others) / 100)
        else:
            assert got["observed_median"] is None

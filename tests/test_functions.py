from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from chainrollup.functions import numbers, time
from chainrollup.operators import buckets, kpis, offers, pricing, state, windows


def test_windows_of_a_range():
    a, b = date(2026, 1, 10), date(2026, 1, 14)
    assert time.prior_window(a, b) == (date(2026, 1, 5), date(2026, 1, 9))
    assert time.prior_prior_window(a, b) == (date(2025, 12, 31), date(2026, 1, 4))
    assert time.context_window(a, b) == (date(2025, 12, 11), date(2026, 1, 9))
    h = datetime(2026, 1, 1, 5)
    assert time.prior_window(h, h, "hour") == (datetime(2026, 1, 1, 4), datetime(2026, 1, 1, 4))
    assert time.clamp_range(a, b, date(2026, 1, 12)) == (date(2026, 1, 12), b)
    assert time.clamp_range(a, b, date(2026, 2, 1)) == (date(2026, 2, 1), date(2026, 2, 1))
    assert time.validate_range("2026-01-01", "2026-12-31", "day")[1] == date(2026, 12, 31)
    for bad in (("2026-01-02", "2026-01-01", "day"), ("2026-01-01", "2027-01-05", "week"), ("2026-01-01", "2026-04-01", "hour"), ("20260101", "2026-01-02", "day"), ("x", "y", "day")):
        with pytest.raises(ValueError):
            time.validate_range(*bad)


def test_scores_and_trends(spark):
    rows = [("s", date(2026, 1, k + 1), v) for k, v in enumerate([95.0, 105.0] * 5 + [150.0])]
    got = windows.trailing_zscore(spark.createDataFrame(rows, "series string, day date, value double")).orderBy("day").collect()
    assert [r.z for r in got[:7]] == [None] * 7 and got[10].z == pytest.approx(10) and got[10].flagged
    nan = float("nan")
    for values, want in (([0.0, nan, 4.0], [0, 2, 4]), ([None, None, 2.0, 3.0, 4.0], [None, None, 2, 3, 4]), ([None, None], [None, None]), ([5.0], [5])):
        df = spark.createDataFrame([("s", date(2026, 1, k + 1), v) for k, v in enumerate(values)], "series string, day date, value double")
        assert [r.trend for r in windows.linear_trend(df).orderBy("day").collect()] == [None if w is None else pytest.approx(w) for w in want]


def test_snapshots(spark):
    def diff(rows):
        return windows.snapshot_diff(spark.createDataFrame(rows, "day date, wallets long, minted long"), 10_000_000).orderBy("day").collect()

    r = diff([(date(2026, 9, 1), 1450, 3680000000), (date(2026, 9, 2), 1452, 3700000000), (date(2026, 9, 5), 1453, 3710000000), (date(2026, 9, 6), 1453, 3710000000), (date(2026, 9, 7), 1400, 1)])
    assert (r[0].n_new, r[1].n_new, r[1].n_minted, r[1].matches_fee) == (None, 2, 20000000, True)
    assert (r[2].gap_days, r[3].n_new, r[3].rate, r[4].n_new) == (2, 0, None, None)


def test_concentration_numbers_and_percentages(spark):
    w = lambda *v: spark.createDataFrame([(float(x),) for x in v], "w double")
    assert [pricing.hhi(w(*v), "w").first().hhi for v in ((100,), (50, 50), (0, 0))] == [1, 0.5, None]
    assert pricing.top_n_share(w(50, 30, 20), "w", 2).first().top_share == pytest.approx(0.8)
    df = spark.createDataFrame([(-20000, 9), (0, 0), (5, 0), (1, 3), (3, -7)], "a long, b long")
    got = [r[0] for r in df.select(numbers.pct_change(F.col("a") + F.col("b"), F.col("b"))).collect()]
    assert got[0] == -222222.22 and got[1:3] == [0.0, None] and got[3] == 33.33 and got[4] == -42.85
    d = spark.createDataFrame([("1500000", 6), ("-1", 2), ("7", 0), ("x", 2), ("12", 40)], "u string, d int")
    assert [r[0] for r in d.select(numbers.atomic_to_decimal(F.col("u"), F.col("d"))).collect()] == ["1.5", "-0.01", "7", "x", "12"]


def test_coverage_and_alignment(spark):
    floors = spark.createDataFrame([("base", datetime(2026, 5, 30, 6, 51, 13))], "series string, floor timestamp")
    for grain, cases in {"hour": [("2026-05-30 06:00:00", False), ("2026-05-30 05:00:00", True)], "day": [("2026-05-30", False), ("2026-05-29", True)], "week": [("2026-05-25", False), ("2026-05-18", True)]}.items():
        df = spark.createDataFrame([(s, b) for b, _ in cases for s in ("base", "unknown")], "series string, bucket string")
        got = {(r.series, r.bucket): r.uncovered for r in buckets.with_coverage(df, floors, grain).collect()}
        assert got == {("base", b): u for b, u in cases} | {("unknown", b): False for b, _ in cases}
    rows = spark.createDataFrame([("01-02", "a", 5), ("01-01", "a", 1), ("01-02", "b", 9), ("01-03", "b", None)], "bucket string, series string, value long")
    assert sorted(map(tuple, buckets.series_align(rows, ["a", "b"]).collect())) == [("01-01", 1, 0), ("01-02", 5, 9), ("01-03", 0, None)]
    assert buckets.dense_days(spark, date(2026, 1, 2), date(2026, 1, 1)).count() == 0
    hourly = spark.createDataFrame([("s", "", 4), ("s", "", 6), ("t", "", 1)], "series string, dimension string, value long")
    daily = spark.createDataFrame([("s", "", 10), ("t", "", 2)], "series string, dimension string, value long")
    assert [tuple(r) for r in state.parity_check(hourly, daily).collect()] == [("t", "", 1, 2)]


def test_organic_and_offers(spark):
    day = lambda d, **k: [(date(2026, 1, d), "offer_category", c, v) for c, v in k.items()]
    df = spark.createDataFrame(day(1, vaults=3, psm=1, oracle=12, other=4) + day(2, vaults=2, auction=2, orchestration=6) + day(3, governance=1, fast_usdc=9), "day date, series string, dimension string, value long")
    got = {r.period: (r.interactive, r.automated, r.unknown, r.organic_pct) for r in offers.organic_activity(df, (date(2026, 1, 2), date(2026, 1, 3)), (date(2026, 1, 1), date(2026, 1, 1))).collect()}
    assert got == {"range": (5, 15, 0, 25.0), "prior": (4, 12, 4, 20.0)}
    assert kpis.sum_series(df, "none").first().total == 0

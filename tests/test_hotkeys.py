"""Per-key totals under skew and dirt."""

from plexora.operators import hotkeys

SCHEMA = "u long, v long, w float, k long, n int"


def frame(spark, data):
    return spark.createDataFrame([(*r, 7, 7) for r in data], SCHEMA)


def totals(spark, data):
    got = hotkeys.feature_totals(frame(spark, data), "u", "v", "w").collect()
    return {r["expanded_idx"]: (r["n_rows"], r["sum_weight"], r["n_partners"]) for r in got}


def test_totals_count_every_row_once(spark):
    nan = float("nan")
    data = [(1, 2, 0.5), (2, 1, 0.25), (1, 1, 1.0), (1, None, 2.0), (None, -1, 9.0), (-1, 3, None), (3, 4, nan)]
    assert totals(spark, data) == {1: (4, 3.75, 1), 2: (2, 0.75, 1), 3: (2, None, 1), 4: (1, None, 1)}


def test_totals_of_a_hot_key(spark):
    data = [(0, i % 50, 1.0) for i in range(3000)] + [(i, i + 1, 1.0) for i in range(100, 130)]
    got = totals(spark, data)
    assert got[0] == (3000, 3000.0, 49) and got[7] == (60, 60.0, 1)
    heavy = hotkeys.heavy_features(frame(spark, data), "u", "v", "w", 0.5).collect()
    assert [r["expanded_idx"] for r in heavy] == [0]


def test_share_is_exact(spark):
    data = [(i, -1, 1.0) for i in range(93)] + [(1000, -1, 1.0)] * 7
    heavy = hotkeys.heavy_features(frame(spark, data), "u", "v", "w", 0.07).collect()
    assert [r["expanded_idx"] for r in heavy] == [1000]


def test_empty(spark):
    assert totals(spark, []) == {}
    assert hotkeys.heavy_features(frame(spark, []), "u", "v", "w").collect() == []

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import frames_of, sorted_rows
from trajlake.operators import annotations, corpus, episodes, insights, segments, series, stats
from trajlake.operators.blocks import KEYS, as_of, exact_ranks, positions


def table(spark, seconds):
    rows = [("d", i, s) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "dataset string, episode_index long, seconds double")


def test_positions_of_long_groups(spark, blocks):
    rows = [("d", 0, float(i * i % 97), i) for i in range(97)] + [("d", 1, 1.0, i) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, t double, id long")
    out = positions(df, ["t", "id"], F.col("t"))
    want = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[1], r[4]))
    assert [r[:4] for r in got] == want
    assert [r[4] for r in got if r[1] == 0] == list(range(97))


def test_exact_ranks(spark):
    values = [float(x) for x in (5, 1, 1, 1, 9, -3, 0, 0, 7, 2.5)]
    df = spark.createDataFrame([("d", v) for v in values], "dataset string, v double")
    n = F.col("n")
    row = exact_ranks(df, ["dataset"], "v", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1}).first()
    s = sorted(values)
    assert (row["n"], row["lo"], row["mid"], row["hi"]) == (10, s[0], s[5], s[9])


def test_as_of_matches_scan(spark):
    marks = [("d", 0, 2.0, "a", 0), ("d", 0, 2.0, "b", 1), ("d", 0, 31.0, "c", 2), ("d", 1, 50.0, "z", 0)]
    rows = [("d", e, float(t)) for e in (0, 1, 2) for t in (0, 2, 3, 9, 30, 31, 99)]
    m = spark.createDataFrame(marks, "dataset string, episode_index long, t double, v string, o int")
    r = spark.createDataFrame(rows, "dataset string, episode_index long, t double")
    for width in (1.0, 4.0, 1000.0):
        got = {(x[1], x[2]): x[3] for x in as_of(r, m, "t", "v", width, tie=["o"]).collect()}
        assert len(got) == len(rows)
        for _, e, t in rows:
            seen = [x for x in marks if x[1] == e and x[2] <= t]
            assert got[(e, t)] == (max(seen, key=lambda x: (x[2], x[4]))[3] if seen else None)


def test_scope(spark, blocks):
    ids = spark.createDataFrame([("d", i) for i in (2, 7, 10, 11, 50, 100, 101)], "dataset string, episode_index long")
    assert [r[1] for r in sorted_rows(episodes.scope(ids, first=3).orderBy("episode_index"))] == [10, 2, 7]
    got = {r[1] for r in episodes.scope(ids, first=1, between=(10, 100)).collect()}
    assert got == {10, 11, 50, 100}


def test_bin_members(spark):
    df = table(spark, [5.0, 15.0, 25.0, 12.0])
    bins = spark.createDataFrame([("d", 0.0, 10.0, 3)], "dataset string, minimum double, width double, bins int")
    out = episodes.bin_members(df, bins).orderBy("bin", "place").collect()
    assert [(r["bin"], r["episode_index"]) for r in out] == [(0, 0), (1, 1), (1, 3), (2, 2)]


def test_equal_lengths_make_one_bin(spark):
    df = table(spark, [4.0, 4.0, 4.0])
    bins = episodes.histogram_bins(df)
    assert tuple(bins.first()) == ("d", 4.0, 0.0, 1)
    assert episodes.histogram(df, bins).first()["episodes"] == 3


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 21, 57, 400])
def test_even_sample_positions(spark, n):
    f = spark.range(n).select(F.col("id").alias("position"), F.lit(n).alias("n"))
    got = sorted(r[0] for r in f.where(episodes.is_even_sample(F.col("position"), F.col("n"), 20)).collect())
    want = sorted({math.floor(i * (n - 1) / 19 + 0.5) for i in range(20)}) if n > 20 else list(range(n))
    assert got == want


def acf(x, lags):
    c = x - x.mean()
    v = (c * c).sum()
    return [0.0 if v == 0 else float((c[: len(c) - k] * c[k:]).sum() / v) for k in range(1, lags + 1)]


def test_autocorrelation(spark, blocks):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=17).cumsum(), np.full(23, 2.0)
    f = frames_of(spark, {0: [[float(x)] for x in a], 1: [[float(x)] for x in b]})
    got = {r["lag"]: r["acf"] for r in insights.autocorrelation(f, 100).collect()}
    # Lags 9 to 11 are within half of the longer episode only.
    want = [*np.array([acf(a, 8), acf(b, 8)]).mean(0), *acf(b, 11)[8:]]
    assert sorted(got) == list(range(1, 12))
    assert [got[k + 1] for k in range(11)] == pytest.approx(want)


def test_a_short_episode_leaves_the_other_lags_alone(spark, blocks):
    rng = np.random.default_rng(4)
    cells = {e: [[float(x)] for x in rng.normal(size=n)] for e, n in ((0, 60), (1, 60), (2, 3))}
    got = insights.autocorrelation(frames_of(spark, cells), 100).collect()
    assert sorted((r["lag"], r["episodes"]) for r in got) == [(k, 2) for k in range(1, 31)]


def test_alignment_finds_the_delay(spark, blocks):
    rng = np.random.default_rng(5)
    x = rng.normal(size=80).cumsum()
    cells = [([float(x[i])], [float(x[max(i - 4, 0)])]) for i in range(80)]
    pairs = spark.createDataFrame([("d", 0, 0)], "dataset string, action_dim int, state_dim int")
    peaks = insights.alignment_peaks(insights.cross_correlation(frames_of(spark, {0: cells}), pairs, max_lag=10)).first()
    assert peaks["mean_peak_lag"] == 4 and peaks["mean_peak"] > 0.9


def test_movement_and_activity(spark, blocks):
    f = frames_of(spark, {0: [[0.0, 0.0], [3.0, 4.0], [3.0, 4.0]], 1: [[1.0, 1.0]]})
    got = {r["episode_index"]: r["movement"] for r in insights.movement(f).collect()}
    assert got == {0: 2.5, 1: 0.0}
    ranges = insights.motor_ranges(f)
    assert {r["dim"]: (r["motor_range"], r["distinct_values"]) for r in ranges.collect()} == {0: (3.0, 3), 1: (4.0, 3)}
    active = insights.activity(f, ranges)
    assert {(r["episode_index"], r["dim"]): r["active"] for r in active.collect()} == {
        (0, 0): True, (0, 1): True, (1, 0): False, (1, 1): False,
    }


def test_rows_without_vectors_are_numbered_out(spark, blocks):
    f = frames_of(spark, {0: [[0.0], None, [2.0], [4.0]]})
    assert insights.movement(insights.present(f)).first()["movement"] == 2.0


def test_series_range_ignores_non_finite(spark):
    rows = [("d", "a", v) for v in (math.inf, 3.0, math.nan)]
    s = spark.createDataFrame(rows, "dataset string, series string, value double")
    assert tuple(stats.series_range(s).first()) == ("d", "a", 3.0, 3.0)


def test_suffix_groups(spark):
    f = frames_of(spark, {0: [([1.0, 2.0], [5.0])]})
    names = spark.createDataFrame(
        [("d", "action", 0, "j"), ("d", "action", 1, "k"), ("d", "observation.state", 0, "j")],
        "dataset string, feature string, dim int, name string",
    )
    out = series.group_by_suffix(series.flatten(f, ["action", "observation.state"], names))
    got = {r["key"]: (r["grouped"], dict(r["values"])) for r in out.collect()}
    assert got == {"j": (True, {"action": 1.0, "observation.state": 5.0}), "action | k": (False, {"action": 2.0})}


def test_segments_become_contiguous(spark, blocks):
    rows = [("d", 0, s, None, f"t{s}", i) for i, s in enumerate((100, 0, 250))]
    raw = spark.createDataFrame(
        rows, "dataset string, episode_index long, start_frame_index long, success_frame_index long, instruction string, entry long"
    )
    last = spark.createDataFrame([("d", 0, 400)], "dataset string, episode_index long, last_frame long")
    out = segments.normalise(raw, last).orderBy("segment_id")
    assert [(r["start_frame_index"], r["end_frame_index"]) for r in out.collect()] == [(0, 100), (100, 250), (250, 400)]


def test_task_precedence(spark):
    rows = [("d", e, p, e, t) for e in (0, 1, 2) for p, t in enumerate([None, "say" if e == 1 else None, None])]
    frames = spark.createDataFrame(
        rows, "dataset string, episode_index long, position long, task_index long, language_instruction string"
    )
    eps = spark.createDataFrame([("d", 0, ["own", "two"]), ("d", 1, []), ("d", 2, None)], "dataset string, episode_index long, tasks array<string>")
    tasks = spark.createDataFrame([("d", i, f"listed {i}") for i in range(3)], "dataset string, task_index long, task string")
    got = {r["episode_index"]: r["task"] for r in annotations.episode_task(frames, eps, tasks).collect()}
    assert got == {0: "own\ntwo", 1: "say", 2: "listed 2"}


def test_hours(spark):
    row = spark.range(1).select(
        corpus.hours(F.lit(108000), F.lit(30.0)), corpus.hours(F.lit(10), F.lit(0.0)), corpus.prefix(F.lit("solo")), corpus.task_name(F.lit("a/b/c"))
    ).first()
    assert list(row) == [1.0, 0.0, "Ungrouped", "b/c"]

"""The shared statistics table against plain Python."""

import math
import random

import numpy as np
import pytest

from helpers import frames_of
from trajlake.checks import data
from trajlake.checks.findings import Recording
from trajlake.operators import moments

NAN, INF = float("nan"), float("inf")


def sample():
    r = random.Random(4)
    episodes = {}
    for e in range(6):
        rows = [([r.uniform(-1, 1) + 1000, float(r.randrange(3)), 7.0], [r.uniform(0, 1)]) for _ in range(r.randrange(3, 20))]
        episodes[e] = rows
    episodes[1][0] = ([NAN, 1.0, 7.0], [0.5])
    episodes[2][1] = ([1.0, INF, 7.0], [NAN])
    episodes[3].append(([1.0, 2.0], [0.1]))  # two widths: no matrix
    episodes[4].append((None, [0.1]))  # a row with no vector
    episodes[5].append(([1.0, 2.0, 7.0], []))
    return episodes


def brute(episodes, usable, pick):
    rows = np.array([pick(row) for e in usable for row in episodes[e]])
    ok = np.isfinite(rows).all(axis=1)
    kept = rows[ok]
    z = np.abs(kept - kept.mean(0)) / np.where(kept.std(0) == 0, np.nan, kept.std(0))
    return {
        d: (len(rows), len(kept), int(np.isnan(rows[:, d]).sum()), int(np.isinf(rows[:, d]).sum()), kept[:, d].mean(), kept[:, d].std(),
            int((kept[:, d] == kept[:, d].min()).sum()), int((kept[:, d] == kept[:, d].max()).sum()), int((z[:, d] > 1.5).sum()))
        for d in range(rows.shape[1])
    }


@pytest.mark.parametrize("broadcast", [10_000, -1])
def test_summaries_equal_plain_python(spark, blocks, monkeypatch, broadcast):
    monkeypatch.setattr(moments, "BROADCAST_DATASETS", broadcast)
    episodes = sample()
    frames = frames_of(spark, episodes).withColumnRenamed("observation.state", "state")
    columns = ["action", "state"]
    table = moments.moments(frames, columns).cache()
    summary = moments.merged(moments.of_one_width(table)).cache()
    beyond = moments.counts_beyond(frames, table, summary, columns, 1.5)
    got = {}
    for r in summary.join(beyond, ["dataset", "column", "dim"]).collect():
        got.setdefault(r.column, {})[r.dim] = (r.total_rows, r["count"], r.nan_count, r.inf_count, r.mean, r.std, r.at_minimum, r.at_maximum, r.outliers)
    want = {"action": brute(episodes, [0, 1, 2, 5], lambda x: x[0]), "state": brute(episodes, [0, 1, 2, 3, 4], lambda x: x[1])}
    assert got.keys() == want.keys()
    for c in want:
        for d, row in want[c].items():
            assert got[c][d] == pytest.approx(row, rel=1e-9), (c, d)
    assert got["action"][2][5] == 0.0


def test_variance_far_from_zero(spark):
    frames = frames_of(spark, {e: [([1e9 + i % 3 + e], [0.0]) for i in range(30)] for e in range(4)})
    row = moments.merged(moments.moments(frames, ["action"]).cache()).first()
    values = [1e9 + i % 3 + e for e in range(4) for i in range(30)]
    assert math.isclose(row.std, float(np.std(values)), rel_tol=1e-6)


def test_datasets_of_two_widths_have_no_summary(spark):
    frames = frames_of(spark, {0: [([1.0], [0.0])], 1: [([1.0, 2.0], [0.0])]})
    table = moments.moments(frames, ["action", "observation.state"])
    assert {r.column for r in moments.of_one_width(table).collect()} == {"observation.state"}
    assert moments.moments(frames, []).count() == 0
    assert moments.moments(frames.where("false"), ["action"]).count() == 0


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_frames_are_read_once_whatever_the_columns(spark, tmp_path):
    frames = frames_of(spark, sample()).withColumnRenamed("observation.state", "state")
    wide = frames.selectExpr("*", *[f"action as action_{i}" for i in range(12)])
    wide.write.parquet(f"{tmp_path}/wide")
    stored = spark.read.parquet(f"{tmp_path}/wide")
    assert scans(moments.moments(stored, ["action"])) == scans(moments.moments(stored, [f"action_{i}" for i in range(12)])) == 1
    rec = Recording(frames=stored)
    rec.numeric_columns()
    names = {r.column for r in rec.summaries().select("column").distinct().collect()}
    assert len(names) == 14 and rec.moments() is rec.moments()
    found = data.statistics(rec)
    assert found.where("metric = 'nan_count'").count() == 14

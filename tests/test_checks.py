import math

import pytest
from pyspark.sql import functions as F

from helpers import frames_of, sorted_rows
from trajlake.checks import data, files, report
from trajlake.checks.findings import Recording, affected_episodes, check_summary
from trajlake.operators import duplicates as dup
from trajlake.operators import motion, motion_checks, stats


def infos(spark, fps=10.0, dataset="d"):
    return spark.createDataFrame([(dataset, fps)], "dataset string, fps double")


def healthy(spark):
    return {0: [([f / 10, f / 20], [float(f), f + 1.0]) for f in range(10)]}


def bad(df):
    return {(r["severity"], r["metric"], r["episode_index"]) for r in df.collect() if r["severity"] != "PASS"}


def test_healthy_recording_passes_temporal(spark, blocks):
    rec = Recording(frames=frames_of(spark, healthy(spark)), infos=infos(spark))
    assert bad(data.temporal(rec)) == set()
    found = data.episode_health(rec)
    assert ("WARN", "chunk_size", None) in bad(found)
    assert found.where("metric = 'chunk_size'").first()["value"] == 16


def test_bad_clock(spark, blocks):
    f = frames_of(spark, healthy(spark))
    f = f.withColumn("timestamp", F.when(F.col("position") == 4, 0.1).otherwise(F.col("timestamp")))
    f = f.withColumn("frame_index", F.when(F.col("position") == 5, 99).otherwise(F.col("frame_index")))
    found = bad(data.temporal(Recording(frames=f, infos=infos(spark))))
    assert ("WARN", "non_monotonic", 0) in found
    assert ("WARN", "frame_index", 0) in found


def test_invalid_rate_fails(spark):
    rec = Recording(frames=frames_of(spark, healthy(spark)), infos=infos(spark, 0.0))
    assert bad(data.temporal(rec)) == {("FAIL", "fps", None)}


def test_nan_action_fails(spark, blocks):
    cells = healthy(spark)[0]
    cells[3] = ([math.nan, 0.0], cells[3][1])
    rec = Recording(frames=frames_of(spark, {0: cells}), infos=infos(spark))
    assert ("FAIL", "nan_count", None) in bad(data.actions(rec))
    assert ("WARN", "nan_count", 0) in bad(data.per_episode(rec))
    assert sorted_rows(affected_episodes(data.per_episode(rec))) == [("d", 0)]


def test_row_with_nan_leaves_all_dims(spark, blocks):
    f = frames_of(spark, {0: [[1.0, 1.0], [math.nan, 100.0], [3.0, 3.0], [math.inf, 5.0]]})
    out = {r["dim"]: r for r in stats.full_summary(f, "action").collect()}
    assert out[1]["count"] == 2 and out[1]["maximum"] == 3.0 and out[1]["mean"] == 2.0
    assert out[0]["nan_count"] == 1 and out[0]["inf_count"] == 1 and out[0]["total_rows"] == 4
    assert out[1]["at_maximum"] == 1


def test_ragged_episode_is_left_out(spark, blocks):
    f = frames_of(spark, {0: [[1.0], [2.0, 3.0]], 1: [[5.0], [7.0]]})
    out = stats.column_summary(f, "action").collect()
    assert [(r["dim"], r["count"], r["mean"]) for r in out] == [(0, 2, 6.0)]


def test_frozen_run_and_jumps(spark, blocks):
    f = frames_of(spark, {0: [[0.0, 0.0], [0.0, 0.0], [2.0, 4.0], [2.0, 4.0]]})
    assert motion_checks.longest_frozen_run(f, "action").first()["longest_run"] == 1
    scales = spark.createDataFrame([("d", [0.1, 0.1])], "dataset string, scale array<double>")
    assert motion_checks.mean_jumps(f, "action", scales=scales).first()["jumps"] == 1


def test_frozen_run_crosses_blocks(spark, blocks):
    values = [0, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3]
    f = frames_of(spark, {0: [[float(v)] for v in values]})
    row = motion_checks.longest_frozen_run(f, "action").first()
    assert (row["n"], row["longest_run"]) == (11, 6)


def test_nan_rows_are_never_frozen(spark, blocks):
    f = frames_of(spark, {0: [[math.nan]] * 6})
    assert motion_checks.longest_frozen_run(f, "action").first()["longest_run"] == 0


def test_coordinated_jump(spark):
    rows = [[0.0, 0.0]] * 5000
    rows[2500] = [100.0, 100.0]
    rec = Recording(frames=frames_of(spark, {0: rows}), infos=infos(spark))

    def fired(threshold, extreme):
        found = data.dimension_jumps(rec, threshold, extreme)
        return found.where("column = 'action' and severity = 'WARN'").count() > 0

    assert fired(30, 40) and not fired(60, 70) and fired(45, 70)


def pose_frames(spark):
    names = ["x", "y", "z", "r1", "r2", "r3", "r4", "r5", "r6"]
    rows = [
        ("d", 0, 0, 0.0, [0.0, 0, 0, 1.0, 0, 0, 0, 1.0, 0]),
        ("d", 0, 1, 0.25, [0.5, 0, 0, 0.0, 1.0, 0, -1.0, 0, 0]),
    ]
    rows = [(a, b, c, t, [float(x) for x in v]) for a, b, c, t, v in rows]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, timestamp double, action array<double>")
    table = spark.createDataFrame(
        [("d", "action", i, f"tcp.{n}") for i, n in enumerate(names)], "dataset string, feature string, dim int, name string"
    )
    return f, table


def test_pose_velocity_and_limits(spark, blocks):
    f, names = pose_frames(spark)
    v = motion.pose_velocity(f, "action", names, infos(spark, 4.0)).where("position = 1").first()
    assert v["vx"] == pytest.approx(2.0) and v["wz"] == pytest.approx(360.0)
    rec = Recording(frames=f, infos=infos(spark, 4.0), names=names)
    found = data.speed_limits(rec).where("severity = 'WARN'").collect()
    assert len(found) == 1 and "vx 2.000" in found[0]["message"]
    assert data.speed_limits(rec, 2.1, 370).where("severity = 'WARN'").count() == 0


def test_speed_limits_count_all_events(spark):
    _, names = pose_frames(spark)
    rows = [("d", 0, i, i / 4, [float(i), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for i in range(13)]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, timestamp double, action array<double>")
    found = data.speed_limits(Recording(frames=f, infos=infos(spark, 4.0), names=names)).where("severity = 'WARN'").collect()
    assert [r["events"] for r in found] == [12] * 5


def test_world_frame_turn(spark):
    # A quarter turn about y, then one about its own x: -180 deg/s about world z in half a second.
    rows = [
        ("d", 0, 0, 0.0, [0.0, 0, -1, 0, 1, 0]),
        ("d", 0, 1, 0.5, [0.0, 0, -1, 1, 0, 0]),
    ]
    rows = [(a, b, c, t, [float(x) for x in v]) for a, b, c, t, v in rows]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, timestamp double, action array<double>")
    names = spark.createDataFrame(
        [("d", "action", i, f"p.r{i + 1}") for i in range(6)], "dataset string, feature string, dim int, name string"
    )
    v = motion.pose_velocity(f, "action", names, infos(spark)).where("position = 1").first()
    assert [round(v[c], 6) + 0.0 for c in ("wx", "wy", "wz")] == [0.0, 0.0, -180.0]


def test_half_turn(spark):
    rows = [
        ("d", 0, 0, 0.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]),
        ("d", 0, 1, 1.0, [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0]),
    ]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, timestamp double, action array<double>")
    names = spark.createDataFrame(
        [("d", "action", i, f"p.r{i + 1}") for i in range(6)], "dataset string, feature string, dim int, name string"
    )
    v = motion.pose_velocity(f, "action", names, infos(spark)).where("position = 1").first()
    assert abs(v["wz"]) == pytest.approx(180.0)


def test_gripper_velocity(spark):
    rows = [("d", 0, i, t, [a]) for i, (t, a) in enumerate([(0.0, 0.2), (0.5, 0.3), (1.0, 0.25)])]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, timestamp double, action array<double>")
    names = spark.createDataFrame([("d", "action", 0, "left_gripper.pos")], "dataset string, feature string, dim int, name string")
    got = [r["velocity"] for r in motion.gripper_velocity(f, "action", names, infos(spark)).orderBy("position").collect()]
    assert got == pytest.approx([0.0, 0.2, -0.1])


def test_length_mismatch_fails(spark):
    rec = Recording(
        frames=frames_of(spark, healthy(spark)),
        infos=infos(spark),
        episodes=spark.createDataFrame([("d", 0, 9)], "dataset string, episode_index long, length long"),
    )
    assert ("FAIL", "length_mismatch", 0) in bad(data.episode_health(rec))


def test_missing_ranges_of_sparse_ids(spark):
    ids = spark.createDataFrame([("d", 0), ("d", 4_000_000_000), ("e", 1), ("e", 2), ("f", None), ("f", 3)], "dataset string, episode_index long")
    assert sorted_rows(motion_checks.missing_ranges(ids)) == [("d", 1, 3_999_999_999, 3_999_999_999)]
    few = spark.createDataFrame([("d", 0), ("d", 70_000)], "dataset string, episode_index long")
    assert motion_checks.missing_episodes(few).count() == 69_999


def test_missing_episodes(spark, blocks):
    f = frames_of(spark, {i: [[0.0]] for i in (2, 3, 7)})
    assert sorted_rows(motion_checks.missing_episodes(f)) == [("d", 4), ("d", 5), ("d", 6)]


def brute_force_pairs(prints):
    count = 0
    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            a, b = prints[i], prints[j]
            if len(a) == len(b) and all(abs(x - y) <= 1e-6 for x, y in zip(a, b)):
                count += 1
    return count


def test_near_duplicates_match_brute_force(spark, blocks):
    base = [[math.sin(i), float(i)] for i in range(12)]
    episodes = {}
    for k in range(12):
        off = [0.0, 0.0, 9e-7, 1.9e-6, 0.3, -9e-7][k % 6]
        episodes[k] = [[a + off, b] for a, b in base]
    episodes[20] = base[:11]
    f = frames_of(spark, episodes)
    prints = dup.fingerprints(f, "action")
    groups = dup.identical_groups(prints)
    got = dup.pair_counts(groups, dup.near_pairs(groups)).first()["pairs"]
    assert got == brute_force_pairs([list(r["print"]) + [float(r["n"])] for r in prints.collect()])


def test_nearest_matches_compare_all_frames(spark, blocks):
    base = [[math.sin(i), float(i)] for i in range(30)]
    off = [0.0, 0.0, 9e-7, 1.9e-6, 0.3, -9e-7, -0.0]
    episodes = {k: [[a + off[k % 7], b] for a, b in base] for k in range(14)}
    for k in (20, 21):  # same ends, other middle
        episodes[k] = [[a + (0.5 if i == 15 else 0.0), b] for i, (a, b) in enumerate(base)]
    episodes[22] = base[:29]
    episodes[4_000_000_000] = base
    episodes[30] = episodes[31] = [[math.nan, 1.0]] * 30
    episodes[32] = episodes[33] = [[1e300, 1.0]] * 30
    got = {r.episode_index: (r.match, r.exact) for r in dup.nearest_matches(frames_of(spark, episodes), "action").collect()}

    def alike(a, b):
        return len(a) == len(b) and all(abs(x - y) <= 1e-6 for p, q in zip(a, b) for x, y in zip(p, q))

    want = {}
    for e, rows in episodes.items():
        lower = [o for o in episodes if o < e and alike(rows, episodes[o])]
        if lower:
            want[e] = (max(lower), episodes[max(lower)] == rows)
    assert got == want
    assert dup.nearest_matches(frames_of(spark, {0: base}), "action").count() == 0


def test_nan_fingerprint_matches_nothing(spark):
    f = frames_of(spark, {0: [[math.nan]] * 12, 1: [[math.nan]] * 12})
    assert dup.fingerprints(f, "action").count() == 0


def test_column_differences_and_shapes(spark):
    f = frames_of(spark, {0: [[1.0]], 1: [[1.0, 2.0]]})
    f = f.withColumn("extra", F.when(F.col("episode_index") == 1, F.lit(1.0)))
    found = bad(files.consistency(Recording(frames=f, infos=infos(spark))))
    assert ("WARN", "extra_column", 1) in found and ("FAIL", "shape", 1) in found


def test_report_sums_up(spark):
    rec = Recording(frames=frames_of(spark, healthy(spark)), infos=infos(spark))
    out = {r["check"]: r["severity"] for r in check_summary(report.run(rec, ["temporal", "episodes"])).collect()}
    assert out == {"temporal": "PASS", "episodes": "WARN"}


def test_report_of_all_checks_has_each_check_of_each_dataset(spark):
    from trajlake.plans import q_checks

    sf = "/root/testdata/sf0.001"
    got = {(r.dataset, r.check): (r.severity, r.findings) for r in q_checks.order_report(spark, sf).collect()}
    datasets = {d for d, _ in got}
    assert len(datasets) > 1 and set(got) == {(d, c) for d in datasets for c in report.CHECKS}
    alone = ["temporal", "videos", "training"]
    for r in q_checks.order_report(spark, sf, alone).collect():
        assert got[r.dataset, r.check] == (r.severity, r.findings)
    assert {s for s, _ in got.values()} == {"PASS", "WARN", "FAIL"}


def test_checks_share_the_passes_over_the_frames(spark, monkeypatch):
    calls = []
    for name in ("longest_frozen_run", "scaled_steps"):
        plain = getattr(motion_checks, name)
        monkeypatch.setattr(motion_checks, name, lambda *a, _n=name, _f=plain, **k: calls.append(_n) or _f(*a, **k))
    still = [([0.01 * (i % 2)], [0.0]) for i in range(4000)]
    rec = Recording(frames=frames_of(spark, {0: [*still, ([90.0], [0.0]), *still], 1: still}), infos=infos(spark))
    column = rec.action_columns()[0]
    found = {c: report.run(rec, [c]).where("metric in ('jumps', 'max_z', 'frozen_share')").count() for c in ("actions", "dimension_jumps", "per_episode")}
    wide = len(set(rec.action_columns()) | set(rec.signal_columns()))
    assert calls.count("longest_frozen_run") <= wide and calls.count("scaled_steps") <= wide
    # The shared steps give what the lone functions give.
    alone = motion_checks.mean_jumps(rec.frames, column).where("jumps > 0").collect()
    assert found["actions"] >= len(alone) and alone == motion_checks.mean_jumps(rec.frames, column, steps=rec.large_steps(column)).collect()
    lone = motion_checks.dimension_jumps(rec.frames, column).orderBy("position").collect()
    assert lone and lone == motion_checks.dimension_jumps(rec.frames, column, steps=rec.large_steps(column)).orderBy("position").collect()


def test_rows_without_an_episode_id_lack_no_column_they_have(spark):
    rows = [("d", 0, 0, 1.0, 1.0), ("d", None, 0, 1.0, 1.0), ("d", 1, 0, None, 1.0)]
    f = spark.createDataFrame(rows, "dataset string, episode_index long, position long, a double, b double")
    assert sorted_rows(files.column_differences(f, ["a", "b"])) == [("d", 1, "a", "missing")]

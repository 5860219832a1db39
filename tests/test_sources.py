import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import sorted_rows
from trajlake.checks import files
from trajlake.checks.findings import Recording
from trajlake.sources import readers, sidecars, sinks


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


def put_parquet(path, **columns):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pd.DataFrame(columns).to_parquet(path)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("recordings"))
    v3, v2 = f"{base}/org/new set", f"{base}/org/old"
    info = {
        "codebase_version": "v3.0", "fps": 10, "total_episodes": 2, "total_frames": 5, "total_tasks": 1,
        "data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet",
        "video_path": "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4",
        "robot_type": "arm", "splits": {"train": "0:2"},
        "features": {
            "action": {"dtype": "float32", "shape": [2], "names": {"motors": ["a", "b"]}},
            "observation.state": {"dtype": "float32", "shape": [2], "names": None},
            "cam": {"dtype": "video", "shape": [480, 640, 3], "names": ["h", "w", "c"]},
        },
    }
    put(f"{v3}/meta/info.json", json.dumps(info, indent=1))
    put(f"{v3}/meta/stats.json", json.dumps({"action": {"mean": [0.5, 1.0], "std": [0.0, 2.0], "count": [5]}}))
    put_parquet(f"{v3}/meta/tasks.parquet", task_index=[0], task=["pick"])
    put(f"{v3}/meta/tasks.jsonl", '{"task_index": 0, "task": "ignored"}\n')
    for file, rows in ((0, [(0, 0), (0, 1), (0, 2)]), (1, [(1, 0), (1, 1)])):
        put_parquet(
            f"{v3}/data/chunk-000/file-{file:03d}.parquet",
            episode_index=[e for e, _ in rows], frame_index=[f for _, f in rows],
            index=[f + 3 * file for _, f in rows], timestamp=[f / 10 for _, f in rows],
            action=[[float(e), float(f)] for e, f in rows], unused=["x"] * len(rows),
        )
    put_parquet(
        f"{v3}/meta/episodes/chunk-000/file-000.parquet",
        **{
            "episode_index": [0, 1], "data/chunk_index": [0, 0], "data/file_index": [0, 1], "dataset_from_index": [0, 3],
            "dataset_to_index": [3, 5], "length": [3, 2], "videos/cam/chunk_index": [0, 0], "videos/cam/file_index": [0, 0],
            "videos/cam/from_timestamp": [0.0, 0.3], "videos/cam/to_timestamp": [0.3, 0.5], "tasks": [["pick"], ["pick"]],
        },
    )
    put(f"{v2}/meta/info.json", json.dumps({**info, "codebase_version": "v2.1", "fps": "x", "chunks_size": 0}))
    put(f"{v2}/meta/episodes.jsonl", '{"episode_index": 0, "length": 2, "tasks": ["t"]}\n\n[1]\n{"episode_index": 1, "length": 1}\n')
    put(f"{v2}/meta/tasks.json", '{"0": "map zero", "7": "map seven"}')
    for e, n in ((0, 2), (1, 1)):
        put_parquet(f"{v2}/data/chunk-000/episode_{e:06d}.parquet", frame_index=list(range(n)), timestamp=[i / 10 for i in range(n)], action=[[9.0, 9.0]] * n)
    put(f"{v3}/nested/meta/info.json", json.dumps(info))
    put(f"{base}/org/.cache/x/meta/info.json", json.dumps(info))
    put(f"{base}/a/b/c/d/meta/info.json", json.dumps(info))
    put(f"{base}/broken/meta/info.json", "not json")
    return base


def test_discovery(spark, root):
    found = ["org/new set", "org/old"]
    assert sorted(r["dataset"] for r in readers.discover(spark, root).collect()) == ["a/b/c/d", *found]
    assert sorted(r["dataset"] for r in readers.discover(spark, root, depth=3).collect()) == found


def test_infos(spark, root):
    rows = {r["dataset"]: r for r in readers.read_infos(spark, root).collect()}
    assert rows["org/new set"]["fps"] == 10.0 and rows["org/new set"]["chunks_size"] == 1000
    assert rows["org/old"]["fps"] is None and rows["org/old"]["chunks_size"] == 1
    assert rows["broken"]["error"] and not rows["org/old"]["error"]
    features = readers.features_of(readers.read_infos(spark, root)).where("dataset = 'org/new set'")
    names = readers.feature_names(features.where("dtype != 'video'"))
    assert sorted((r["feature"], r["dim"], r["name"]) for r in names.collect()) == [
        ("action", 0, "a"), ("action", 1, "b"), ("observation.state", 0, "0"), ("observation.state", 1, "1"),
    ]


def test_frames_of_both_layouts(spark, root):
    frames = readers.read_frames(spark, root, ["action"])
    assert "unused" not in frames.columns
    got = sorted((r["dataset"], r["episode_index"], r["position"]) for r in frames.collect())
    assert got == [
        ("org/new set", 0, 0), ("org/new set", 0, 1), ("org/new set", 0, 2), ("org/new set", 1, 0), ("org/new set", 1, 1),
        ("org/old", 0, 0), ("org/old", 0, 1), ("org/old", 1, 0),
    ]


def test_scan_reads_only_needed_columns(spark, root):
    plan = readers.read_frames(spark, root, ["action"])._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1]


def test_episode_tables(spark, root):
    episodes = readers.normalise_episodes(readers.read_episodes(spark, root))
    got = [(r["episode_index"], r["from_index"], r["to_index"], r["length"], r["video_end"]) for r in episodes.orderBy("episode_index").collect()]
    assert got == [(0, 0, 3, 3, 0.3), (1, 3, 5, 2, 0.5)]
    videos = readers.episode_videos(episodes, ["cam"]).orderBy("episode_index").collect()
    assert [(v["camera"], v["start"], v["end"]) for v in videos] == [("cam", 0.0, 0.3), ("cam", 0.3, 0.5)]
    lines = readers.normalise_episodes(readers.read_episodes_jsonl(spark, root))
    assert sorted((r["dataset"], r["episode_index"], r["length"]) for r in lines.collect()) == [("org/old", 0, 2), ("org/old", 1, 1)]


def test_numbered_episode_columns(spark):
    df = spark.createDataFrame([("d", *range(10))], "dataset string, " + ", ".join(f"`{i}` long" for i in range(10)))
    row = readers.normalise_episodes(df).first()
    assert (row["episode_index"], row["data_chunk"], row["data_file"], row["from_index"], row["to_index"], row["length"]) == (0, 1, 2, 3, 4, 9)
    assert (row["video_chunk"], row["video_file"], row["video_start"], row["video_end"]) == (5, 6, 7.0, 8.0)


def test_tasks_take_the_first_source(spark, root):
    got = sorted_rows(readers.read_tasks(spark, root).select("dataset", "task_index", "task"))
    assert got == [("org/new set", 0, "pick"), ("org/old", 0, "map zero"), ("org/old", 7, "map seven")]


def test_stats(spark, root):
    got = {(r["field"], r["dim"]): r["value"] for r in readers.read_stats(spark, root).collect()}
    assert got == {("mean", 0): 0.5, ("mean", 1): 1.0, ("std", 0): 0.0, ("std", 1): 2.0, ("count", 0): 5.0}


def test_inventory_limit_and_listing(spark, root):
    full = readers.read_inventory(spark, root)
    assert not full.first()["truncated"]
    few = readers.read_inventory(spark, root, limit=3)
    assert few.count() == 3 and few.first()["truncated"]
    listed = [r["path"] for r in readers.list_parquet(full.withColumn("path", F.regexp_replace("path", "^org/new set/", ""))).collect()]
    assert listed[:2] == ["data/chunk-000/file-000.parquet", "data/chunk-000/file-001.parquet"]


def test_metadata_check_on_files(spark, root):
    infos = readers.read_infos(spark, root).where("dataset = 'org/new set'")
    inventory = readers.read_inventory(spark, root).where(F.col("path").startswith("org/new set/"))
    inventory = inventory.withColumns({"dataset": F.lit("org/new set"), "path": F.substring("path", len("org/new set/") + 1, 1000)})
    rec = Recording(
        frames=readers.read_frames(spark, root, ["action"]).where("dataset = 'org/new set'"),
        infos=infos,
        features=readers.features_of(infos),
        tasks=readers.read_tasks(spark, root),
        inventory=inventory,
        episodes=readers.normalise_episodes(readers.read_episodes(spark, root)),
    )
    found = {(r["severity"], r["metric"], r["column"]) for r in files.metadata(rec).collect()}
    assert found == {("WARN", "undelivered_feature", "observation.state")}


def test_segments_in_three_forms(spark):
    def rec(e, text):
        return {"episode_index": e, "instruction_segments": [{"instruction": text, "start_frame_index": 3}]}

    texts = [
        ("lines", "\n".join(json.dumps(rec(1, t)) for t in ("old", "new")) + "\n\n"),
        ("array", json.dumps([rec(1, "x"), rec(2, "y")])),
        ("object", json.dumps(rec(4, "z"), indent=2)),
    ]
    docs = spark.createDataFrame(texts, "dataset string, text string")
    got = sorted((r["dataset"], r["episode_index"], r["instruction"]) for r in sidecars.parse_segments(docs).collect())
    assert got == [("array", 1, "x"), ("array", 2, "y"), ("lines", 1, "new"), ("object", 4, "z")]


def test_atoms_without_role_are_dropped(spark):
    doc = {"version": 1, "episodes": {"3": {"atoms": [{"role": "user", "content": "hi", "camera": ""}, {"content": "no role"}]}}}
    docs = spark.createDataFrame([("d", json.dumps(doc)), ("e", "broken")], "dataset string, text string")
    row = sidecars.parse_atoms(docs).collect()
    assert [(r["episode_index"], r["content"], r["camera"], r["timestamp"]) for r in row] == [(3, "hi", None, 0.0)]


def test_labelled_write_is_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "frame_index long, action array<double>")
    out = sinks.write_labelled(df.withColumn("subtask_index", F.lit(0)), df, f"{tmp_path}/good")
    assert out.count() == 2
    wrong = df.withColumn("action", F.array(F.lit(7.0))).withColumn("subtask_index", F.lit(0))
    with pytest.raises(RuntimeError):
        sinks.write_labelled(wrong, df, f"{tmp_path}/bad")


def test_progress_column_choice(spark):
    rows = [("d", 0, 1.0, None, 5.0), ("d", 0, 0.0, None, 6.0), ("d", 1, 0.0, None, None)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, index double, progress_sparse double, progress_z double")
    got = sorted_rows(readers.pick_progress(df))
    assert got == [("d", 0, "progress_z", 0.0, 6.0), ("d", 0, "progress_z", 1.0, 5.0)]

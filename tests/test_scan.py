"""One root with datasets that share neither layout nor stored types."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions import paths
from trajlake.sources import readers, scan, sinks
from trajlake.sources.scan import common_type

V2 = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"


def put(path, **columns):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(pa.table(columns), path)


def info(base, dataset, template):
    os.makedirs(f"{base}/{dataset}/meta", exist_ok=True)
    with open(f"{base}/{dataset}/meta/info.json", "w") as handle:
        json.dump({"codebase_version": "v3.0", "fps": 10, "data_path": template}, handle)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("mixed"))
    f32, i64, i32 = pa.list_(pa.float32()), pa.int64(), pa.int32()
    # Shared files; the second holds doubles and rows with no episode number.
    info(base, "a [1]", paths.V3_DATA)
    put(f"{base}/a [1]/data/chunk-000/file-000.parquet", episode_index=pa.array([0, 0, 1], i64), index=pa.array([0, 1, 2], i64),
        action=pa.array([[1.0], [2.0], [3.0]], f32), extra=pa.array(["x"] * 3))
    put(f"{base}/a [1]/data/chunk-000/file-001.parquet", episode_index=pa.array([1, None], i64), index=pa.array([3, 4], i64),
        action=pa.array([[4.0], [5.0]], pa.list_(pa.float64())))
    put(f"{base}/a [1]/data/other.parquet", action=pa.array(["no frames"]))
    put(f"{base}/a [1]/meta/tasks.parquet", action=pa.array([True]))
    # One file per episode with no episode column, scalars for vectors.
    info(base, "b", V2)
    for e in (0, 7):
        put(f"{base}/b/data/chunk-000/episode_{e:06d}.parquet", index=pa.array([0, 1], i32), action=pa.array([float(e), 9.0]))
    # No info document; a file whose footer is broken.
    put(f"{base}/deep/c/data/part-00000.parquet", episode_index=pa.array([5], i64), action=pa.array([[6.0]], f32))
    with open(f"{base}/deep/c/data/part-00001.parquet", "w") as handle:
        handle.write("no parquet")
    return base


def test_frames_of_all_layouts(spark, root):
    frames = readers.read_frames(spark, root, ["action"])
    got = sorted((r.dataset, r.file, r.episode_index, r.position, tuple(r.action)) for r in frames.fillna(-1, ["episode_index", "position"]).collect())
    one, two = "data/chunk-000/file-000.parquet", "data/chunk-000/file-001.parquet"
    assert got == [
        ("a [1]", one, 0, 0, (1.0,)), ("a [1]", one, 0, 1, (2.0,)), ("a [1]", one, 1, 0, (3.0,)),
        ("a [1]", two, -1, -1, (5.0,)), ("a [1]", two, 1, 1, (4.0,)),
        ("b", "data/chunk-000/episode_000000.parquet", 0, 0, (0.0,)), ("b", "data/chunk-000/episode_000000.parquet", 0, 1, (9.0,)),
        ("b", "data/chunk-000/episode_000007.parquet", 7, 0, (7.0,)), ("b", "data/chunk-000/episode_000007.parquet", 7, 1, (9.0,)),
        ("deep/c", "data/part-00000.parquet", 5, 0, (6.0,)),
    ]
    assert "extra" not in frames.columns


def test_only_frame_files_are_read(spark, root):
    found = readers.scan_plan(spark, root, ["action", "episode_index", "index"])
    read = [p.replace("file:", "") for group in found for p in group.paths]
    assert not any("meta" in p or "other" in p or "00001" in p and "deep" in p for p in read)
    # One folder stands for its files where they are alike, and not where they differ.
    assert any(p.endswith("/b/data/chunk-000") for p in read)
    assert sorted(p.rsplit("/", 1)[1] for p in read if "a%20" in p or "a [1]" in p) == ["file-000.parquet", "file-001.parquet"]


def test_footers_name_columns_and_errors(spark, root):
    columns = readers.read_columns(spark, root)
    got = {(r.file, r.column): r.kind for r in columns.where("dataset = 'a [1]'").collect()}
    assert got["data/chunk-000/file-000.parquet", "action"] == "float" and got["data/chunk-000/file-001.parquet", "action"] == "double"
    chosen = scan.assigned(scan.parquet_files(spark, root), readers.data_templates(spark, root))
    bad = scan.footers(chosen, root).where("error is not null").collect()
    assert [r.file for r in bad] == ["data/part-00001.parquet"]


def test_located_load_scans_again_only_where_needed(spark, root):
    places = [
        ("a [1]", 0, "data/chunk-000/file-000.parquet", 0, 2), ("a [1]", 1, "data/chunk-000/file-001.parquet", 3, 5),
        ("b", 7, "data/chunk-009/gone.parquet", 0, 2),
    ]
    episodes = spark.createDataFrame(places, "dataset string, episode_index long, file string, from_index long, to_index long")
    out = readers.read_located(spark, root, episodes, ["action"])
    got = sorted((r.dataset, r.episode_index, r.position, r.action[0], r.rescanned) for r in out.collect())
    # The row of file-001 without an episode number lies in the range of episode 1.
    assert got == [("a [1]", 0, 0, 1.0, False), ("a [1]", 0, 1, 2.0, False), ("a [1]", 1, 0, 4.0, False), ("a [1]", 1, 1, 5.0, False),
                   ("b", 7, 0, 7.0, True), ("b", 7, 1, 9.0, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "deep" not in plan
    again = readers.scan_plan(spark, root, ["action"], spark.createDataFrame([("b",)], "dataset string"))
    assert [p.rsplit("/", 3)[1] for g in again for p in g.paths] == ["b"]


def test_common_types():
    f, d, i, n, s = T.FloatType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()
    assert common_type(f, d) == d and common_type(i, n) == n and common_type(n, f) == d
    assert common_type(T.ArrayType(f), d) == T.ArrayType(d)
    assert common_type(T.ArrayType(i), T.ArrayType(n)) == T.ArrayType(n)
    assert common_type(s, n) == s and common_type(T.ArrayType(f), s) == T.ArrayType(s)


def test_empty_root(spark, tmp_path):
    put(f"{tmp_path}/x/meta/only.parquet", a=pa.array([1]))
    assert readers.read_frames(spark, str(tmp_path)).count() == 0
    assert readers.read_episodes(spark, str(tmp_path)).count() == 0


def test_files_of_given_names(spark, tmp_path):
    rows = spark.range(20).select("id", F.concat(F.lit("d e/x="), F.col("id") % 3, F.lit(".parquet")).alias("file"))
    for _ in range(2):
        sinks.write_files(rows, str(tmp_path), order=["id"])
    for k in range(3):
        assert pq.read_table(f"{tmp_path}/d e/x={k}.parquet")["id"].to_pylist() == [i for i in range(20) if i % 3 == k]
    assert os.listdir(tmp_path) == ["d e"]


def test_named_files_start_no_process_each(spark, tmp_path):
    """A file costs its rows: Spark's writer makes a folder and a checksum file for each."""
    rows = spark.range(60).select("id", F.concat(F.lit("data/a b/x="), F.col("id") % 6, F.lit("%+.parquet")).alias("file"))
    for part in (rows, rows.where("id % 6 < 2")):
        sinks.write_files(part, str(tmp_path), order=["id"])
    found = sorted(os.listdir(tmp_path / "data" / "a b"))
    assert found == [f"x={i}%+.parquet" for i in range(6)]
    assert os.listdir(tmp_path) == ["data"]
    assert spark.read.parquet(str(tmp_path / "data" / "a b")).count() == 60


def test_named_files_by_any_store(spark, tmp_path):
    rows = spark.range(6).select("id", F.concat(F.lit("data/a b/x="), F.col("id") % 3, F.lit("%+.parquet")).alias("file"))
    parts = sinks._parts_by_writer(rows.withColumnRenamed("file", "_file").coalesce(1), f"{tmp_path}/.hidden").collect()
    assert sorted(r.file for r in parts) == [f"data/a b/x={i}%+.parquet" for i in range(3)]
    assert all(os.path.exists(f"{tmp_path}/.hidden/{r.part}") for r in parts)


def test_the_driver_moves_and_lists_no_files(spark, tmp_path, monkeypatch):
    """Names of files stay in tasks: a root can hold more of them than the driver."""
    monkeypatch.setattr(sinks, "_move_by_store", None)
    rows = spark.range(60).select("id", F.concat(F.lit("N/data/a b/x="), F.col("id") % 6, F.lit("%+.parquet")).alias("file"))
    old = spark.range(1).coalesce(1)
    old.write.parquet(f"{tmp_path}/old")
    written = next(n for n in os.listdir(f"{tmp_path}/old") if n.startswith("part"))
    os.makedirs(f"{tmp_path}/root/N/data/a b")
    for mark, end in (("", ""), (".", ".crc")):
        os.rename(f"{tmp_path}/old/{mark}{written}{end}", f"{tmp_path}/root/N/data/a b/{mark}x=0%+.parquet{end}")
    sinks.write_files(rows, f"{tmp_path}/root", order=["id"])
    for name in ("_hidden.parquet", ".hidden.parquet", "notes.txt", "empty.parquet"):
        (tmp_path / "root" / "N" / name).write_text("" if name == "empty.parquet" else "x")
    put(f"{tmp_path}/root/_temporary/data/lost.parquet", id=pa.array([1]))
    listed = scan.parquet_files(spark, f"{tmp_path}/root")
    assert "binaryFile" not in listed._jdf.queryExecution().toString()
    assert sorted(r.rel for r in listed.collect()) == [f"N/data/a b/x={i}%+.parquet" for i in range(6)]
    assert {r.rel: r.size for r in listed.collect()} == {
        f"N/data/a b/x={i}%+.parquet": os.path.getsize(f"{tmp_path}/root/N/data/a b/x={i}%+.parquet") for i in range(6)
    }
    # A replaced file's old checksum is gone, so Spark reads the new rows.
    assert spark.read.parquet(f"{tmp_path}/root/N/data/a b").count() == 60


def test_a_file_in_two_parts_is_refused(spark, tmp_path, monkeypatch):
    parts = spark.createDataFrame([("a.parquet", "1"), ("a.parquet", "2")], "file string, part string")
    monkeypatch.setattr(sinks, "_parts_by_tasks", lambda rows, folder: parts)
    with pytest.raises(RuntimeError, match="a.parquet was written in several parts"):
        sinks.write_files(spark.range(1).withColumn("file", F.lit("a.parquet")), str(tmp_path))


def test_moves_by_any_store(spark, tmp_path, monkeypatch):
    """The driver moves a bounded number of files at a time."""
    monkeypatch.setattr(sinks, "MOVES", 2)
    for i in range(5):
        put(f"{tmp_path}/hidden/{i}.parquet", id=pa.array([i]))
    put(f"{tmp_path}/root/a/0.parquet", id=pa.array([9]))
    rows = [(f"{'ab'[i % 2]}/{i}.parquet", f"{i}.parquet") for i in range(5)]
    parts = spark.createDataFrame(rows, "file string, part string")
    sinks._move_by_store(parts, *sinks._store(spark, str(tmp_path)), f"{tmp_path}/hidden", f"{tmp_path}/root")
    assert {f: pq.read_table(f"{tmp_path}/root/{f}")["id"].to_pylist() for f, _ in rows} == {f: [i] for i, (f, _) in enumerate(rows)}


@pytest.fixture
def many(monkeypatch):
    """Every group counts as one of many files."""
    monkeypatch.setattr(scan, "MANY_FILES", 0)
    monkeypatch.setattr(scan, "READ_ROWS", 2)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_many_files_are_opened_by_tasks(spark, root, many, monkeypatch):
    """The same rows, with no file's name on the driver."""
    opened = readers.read_frames(spark, root)
    places = spark.createDataFrame([("b", 7, "data/chunk-009/gone.parquet", 0, 2)], "dataset string, episode_index long, file string, from_index long, to_index long")
    located = readers.read_located(spark, root, places, ["action"])
    assert all(not g.paths for g in readers.scan_plan(spark, root))
    assert "FileScan parquet [episode" not in opened._jdf.queryExecution().toString()
    monkeypatch.setattr(scan, "MANY_FILES", 2_000)
    read, found = readers.read_frames(spark, root), readers.read_located(spark, root, places, ["action"])
    assert opened.schema == read.schema and rows_of(opened) == rows_of(read)
    assert located.schema == found.schema and rows_of(located) == rows_of(found) and located.count() == 2


def test_stored_types_of_many_files(spark, tmp_path, many, monkeypatch):
    day, at = pa.array([1, None, 3], pa.int32()).cast(pa.date32()), pa.array([1, 2, None], pa.int64())
    columns = {
        "path": pa.array(["x", None, "y"]).dictionary_encode(), "big": pa.array(["p", "q", None], pa.large_string()),
        "u8": pa.array([1, None, 255], pa.uint8()), "u64": pa.array([1, None, 2**64 - 1], pa.uint64()), "day": day,
        "raw": pa.array([b"a", None, b""]), "at": at.cast(pa.timestamp("us")), "utc": at.cast(pa.timestamp("ms", tz="UTC")),
        "fixed": pa.array([[1.0, 2.0], [None, 5.0], [3.0, 4.0]], pa.list_(pa.float32(), 2)),
        "nest": pa.array([{"a": 1, "b": [2]}, None, {"a": None, "b": None}]),
    }
    os.makedirs(f"{tmp_path}/d/data")
    pq.write_table(pa.table(columns), f"{tmp_path}/d/data/part-00000.parquet")
    opened = readers.read_frames(spark, str(tmp_path))
    nothing = readers.read_frames(spark, str(tmp_path), ["absent"])
    monkeypatch.setattr(scan, "MANY_FILES", 2_000)
    read = readers.read_frames(spark, str(tmp_path))
    assert opened.schema == read.schema and rows_of(opened) == rows_of(read) and opened.count() == 3
    assert nothing.count() == 3

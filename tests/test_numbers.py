import math

from pyspark.sql import functions as F

from trajlake.functions import numbers as n
from trajlake.functions import paths, tags, vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_nan_fails_comparisons(spark):
    nan = F.lit(float("nan"))
    row = one(spark, n.above(nan, 1), n.below(nan, 1), n.finite(nan), n.finite(F.lit(float("inf"))), n.finite(F.lit(2.0)))
    assert list(row) == [False, False, False, False, True]


def test_round_half_up_goes_to_plus_infinity(spark):
    row = one(spark, *[n.round_half_up(F.lit(x), 0) for x in (-0.5, 0.5, 1.5, -1.5)])
    assert list(row) == [0.0, 1.0, 2.0, -1.0]
    assert math.isnan(one(spark, n.round_half_up(F.lit(float("nan")), 2))[0])


def test_lenient_numbers(spark):
    texts = ["12", " 1.5e3 ", "", "abc", "NaN", "Infinity", "1d", ".5"]
    row = one(spark, *[n.number_or_null(F.lit(t)) for t in texts])
    assert list(row) == [12.0, 1500.0, None, None, None, None, None, 0.5]


def test_log_slot_never_decreases(spark):
    values = [-1e9, -2.0, -1.0, -1e-9, 0.0, 1e-12, 0.5, 0.50001, 1.0, 3.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").orderBy("v")
    slots = [r[0] for r in df.select(n.log_slot(F.col("v"))).collect()]
    assert slots == sorted(slots)


def test_paths(spark):
    template = F.lit("data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet")
    row = one(
        spark,
        paths.v2_data_path(template, F.lit(1234), F.lit(1000)),
        paths.v3_data_path(F.lit(0), F.lit(1234)),
        paths.is_resolved(F.lit("a/{b}")),
        paths.file_group(F.lit("meta/episodes/x.parquet")),
        paths.natural_key(F.lit("file-10")) > paths.natural_key(F.lit("file-2")),
    )
    assert list(row) == [
        "data/chunk-001/episode_001234.parquet",
        "data/chunk-000/file-1234.parquet",
        False,
        "episodes",
        True,
    ]


def test_tags(spark):
    row = one(
        spark,
        tags.clean_tag(F.lit("  Pick And\tPlace  ")),
        tags.clean_tag(F.lit("   ")),
        tags.clean_objects(F.array(F.lit("Cup"), F.lit("cup "), F.lit(""), F.lit("Box"))),
        F.length(tags.clean_notes(F.lit("x" * 700))),
        F.length(tags.clean_notes(F.lit("x" * 700), 500)),
        F.size(tags.clean_objects(F.array(*[F.lit(f"o{i}") for i in range(30)]))),
    )
    assert list(row) == ["pick_and_place", None, ["cup", "box"], 700, 500, 30]


def test_units_and_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0]], 5.0, [400.0, 2048.0])], "m array<array<double>>, s double, t array<double>")
    row = df.select(
        vectors.vector(df, "m"), vectors.vector(df, "s"), vectors.unit(F.col("t")), vectors.to_radians(F.col("t"))[1], vectors.shape(df, "m")
    ).first()
    assert list(row) == [[1.0, 2.0, 3.0], [5.0], "ticks", 0.0, "null"]

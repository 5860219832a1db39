"""Per-dimension statistics of vector columns, over whole datasets."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import above, finite, or_one, round_half_up
from trajlake.functions.vectors import all_finite, is_usable, vector
from trajlake.operators import moments
from trajlake.operators.blocks import KEYS, blocked, core, window
from trajlake.session import cut


class Matrix(NamedTuple):
    """Vector rows and the episodes in which they form a matrix."""

    rows: DataFrame
    episodes: DataFrame


def prepare(frames: DataFrame, column: str) -> Matrix:
    """A matrix whose episode table is found once, for use by several functions.

    Every function below takes it in place of the frames.
    """
    rows, episodes = matrix(frames, column)
    return Matrix(rows, cut(episodes))


def matrix(frames: DataFrame | Matrix, column: str) -> Matrix:
    """Rows ``(keys, position, v)`` and the episodes whose rows form a matrix.

    An episode counts only when every cell is a non-empty numeric vector of one
    width; joining the rows to the returned episodes applies that rule.
    """
    if isinstance(frames, Matrix):
        return frames
    rows = frames.select(*KEYS, "position", vector(frames, column).alias("v"))
    episodes = (
        rows.groupBy(*KEYS)
        .agg(
            F.count("*").alias("n"),
            F.min(F.size("v")).alias("width"),
            F.max(F.size("v")).alias("_widest"),
            F.bool_and(F.coalesce(is_usable(F.col("v")), F.lit(False))).alias("_usable"),
        )
        .where(F.col("_usable") & (F.col("width") == F.col("_widest")))
        .drop("_usable", "_widest")
    )
    return Matrix(rows, episodes)


def summarize(vectors: DataFrame, *keys: str) -> DataFrame:
    """One pass of moments per (keys, dim) over rows holding a vector ``v``.

    A row with any NaN or infinity is left out of every dimension, but its NaN
    and infinite values are counted.
    """
    keys = keys or ("dataset",)
    ok = all_finite(F.col("v"))
    long = vectors.select(*keys, ok.alias("_ok"), F.posexplode("v").alias("dim", "_x"))
    kept = F.when(F.col("_ok"), F.col("_x"))
    out = long.groupBy(*keys, "dim").agg(
        F.count("*").alias("total_rows"),
        F.count(kept).alias("count"),
        F.count_if(F.isnan("_x")).alias("nan_count"),
        F.count_if(F.abs("_x") == float("inf")).alias("inf_count"),
        F.avg(kept).alias("mean"),
        F.var_pop(kept).alias("_var"),
        F.min(kept).alias("minimum"),
        F.max(kept).alias("maximum"),
    )
    # min = max decides "constant"; summed squares may leave a float residue.
    variance = F.when(F.col("minimum") == F.col("maximum"), F.lit(0.0)).otherwise(F.col("_var"))
    return out.withColumn("m2", variance * F.col("count")).withColumn("std", F.sqrt(variance)).drop("_var")


def _moments(frames: DataFrame | Matrix, column: str) -> DataFrame:
    source, name = (frames.rows, "v") if isinstance(frames, Matrix) else (frames, column)
    return cut(moments.moments(source, [name]))


def column_summary(frames: DataFrame | Matrix, column: str, episodes_kept: DataFrame | None = None) -> DataFrame:
    """Summary per (dataset, dim); optionally over a list of episodes only. Its moments are written as the plan is made."""
    table = _moments(frames, column)
    if episodes_kept is not None:
        kept = moments.of_one_width(table).join(episodes_kept.select(*KEYS).distinct(), KEYS, "left_semi")
    else:
        kept = moments.of_one_width(table)
    return moments.merged(kept).drop("column")


def with_previous(frames: DataFrame, column: str, *extra: str) -> DataFrame:
    """Usable rows with the previous row's vector as ``p`` (null on the first row)."""
    rows, episodes = matrix(frames, column)
    if extra:
        rows = frames.select(*KEYS, "position", vector(frames, column).alias("v"), *extra)
    near = blocked(rows, before=1, episodes=episodes)
    return near.withColumn("p", F.lag("v").over(window())).where(core())


def difference(v: Column, p: Column) -> Column:
    return F.zip_with(v, p, lambda a, b: a - b)


def diff_summary(frames: DataFrame | Matrix, column: str) -> DataFrame:
    """Summary of frame-to-frame differences within each episode."""
    steps = with_previous(frames, column).where(F.col("p").isNotNull())
    steps = steps.select("dataset", "width", difference(F.col("v"), F.col("p")).alias("v"))
    mixed = (
        steps.groupBy("dataset").agg(F.min("width").alias("_a"), F.max("width").alias("_b"))
        .where(F.col("_a") == F.col("_b")).select("dataset")
    )
    return summarize(steps).join(mixed, "dataset", "left_semi")


def as_arrays(summary: DataFrame, **columns: Column) -> DataFrame:
    """Fold (dataset, dim) rows into one row of arrays per dataset, in dim order."""
    packed = F.sort_array(F.collect_list(F.struct("dim", *[c.alias(k) for k, c in columns.items()])))
    folded = summary.groupBy("dataset").agg(packed.alias("_all"))
    return folded.select("dataset", *[F.col(f"_all.{k}").alias(k) for k in columns])


def step_scales(frames: DataFrame | Matrix, column: str) -> DataFrame:
    """Per dataset, the std of each dimension's differences, zero replaced by one."""
    return as_arrays(diff_summary(frames, column), scale=or_one(F.col("std")))


def _beyond(frames: DataFrame | Matrix, column: str, summary: DataFrame, limit: float) -> DataFrame:
    source, name = (frames.rows, "v") if isinstance(frames, Matrix) else (frames, column)
    usable = matrix(frames, column).episodes.select(*KEYS, F.lit(name).alias("column"))
    counts = moments.counts_beyond(source, usable, summary.withColumn("column", F.lit(name)), [name], limit)
    return counts.drop("column")


def extremes_share(frames: DataFrame | Matrix, column: str, summary: DataFrame) -> DataFrame:
    """Add at_minimum/at_maximum: how many finite rows sit on the extremes."""
    counts = _beyond(frames, column, summary, 10.0).drop("outliers")
    return summary.join(counts, ["dataset", "dim"], "left").na.fill(0, ["at_minimum", "at_maximum"])


def full_summary(frames: DataFrame | Matrix, column: str) -> DataFrame:
    return extremes_share(frames, column, column_summary(frames, column))


def clip_share(full: DataFrame) -> DataFrame:
    """Share of values at the minimum and maximum, for dims that vary over >10 rows."""
    return (
        full.where((F.col("minimum") != F.col("maximum")) & (F.col("count") > 10))
        .withColumn("min_share", F.col("at_minimum") / F.col("count"))
        .withColumn("max_share", F.col("at_maximum") / F.col("count"))
    )


def outlier_counts(frames: DataFrame | Matrix, column: str, summary: DataFrame, limit: float = 10.0) -> DataFrame:
    """Finite rows more than ``limit`` standard deviations from the mean, per dim."""
    return _beyond(frames, column, summary, limit).select("dataset", "dim", "outliers")


def constant_dims(summary: DataFrame) -> DataFrame:
    """Dims with one value everywhere, and whether every dim of the column is so."""
    per = summary.groupBy("dataset").agg(
        F.count("*").alias("dims"),
        F.count_if((F.col("count") > 0) & (F.col("minimum") == F.col("maximum"))).alias("constant_dims"),
    )
    return (
        summary.where((F.col("count") > 0) & (F.col("minimum") == F.col("maximum")))
        .select("dataset", "dim", F.col("minimum").alias("value"))
        .join(per.where(F.col("constant_dims") > 0), "dataset")
        .withColumn("all_constant", F.col("dims") == F.col("constant_dims"))
    )


def series_range(series: DataFrame, *keys: str, digits: int = 3) -> DataFrame:
    """Min and max of every named series, non-finite values ignored, rounded."""
    keys = keys or ("dataset", "series")
    kept = F.when(finite(F.col("value")), F.col("value"))
    return (
        series.groupBy(*keys)
        .agg(F.min(kept).alias("_lo"), F.max(kept).alias("_hi"))
        .where(F.col("_lo").isNotNull())
        .select(
            *keys,
            round_half_up(F.col("_lo"), digits).alias("minimum"),
            round_half_up(F.col("_hi"), digits).alias("maximum"),
        )
    )


def group_range(series: DataFrame, *keys: str) -> DataFrame:
    """Min and max over all series of a suffix group; only NaN is ignored."""
    kept = F.when(~F.isnan("value"), F.col("value"))
    return series.groupBy(*keys).agg(F.min(kept).alias("minimum"), F.max(kept).alias("maximum"))


def distribution_shift(frames: DataFrame | Matrix, column: str, episode_rank: DataFrame, limit: float = 3.0) -> DataFrame:
    """Largest mean shift between the first and last quarter of the episodes.

    ``episode_rank`` holds ``rank`` (0-based episode order) and ``episodes`` per episode.
    """
    return shift_of(_moments(frames, column), episode_rank, limit).drop("column")


def shift_of(table: DataFrame, episode_rank: DataFrame, limit: float = 3.0) -> DataFrame:
    """:func:`distribution_shift` of all columns of a written table of moments."""
    quarter = F.floor(F.col("episodes") / 4)
    part = F.when(F.col("rank") < quarter, F.lit(0)).when(
        F.col("rank") >= F.col("episodes") - quarter, F.lit(1)
    )
    sides = episode_rank.where(F.col("episodes") >= 10).select(*KEYS, part.alias("_part")).where(F.col("_part").isNotNull())
    stats = moments.merged(table.join(sides, KEYS), "dataset", "_part")
    first = stats.where("_part = 0").select("dataset", "column", "dim", F.col("mean").alias("_m0"), "std")
    last = stats.where("_part = 1").select("dataset", "column", "dim", F.col("mean").alias("_m1"))
    both = first.join(last, ["dataset", "column", "dim"]).withColumn(
        "shift", F.abs(F.col("_m1") - F.col("_m0")) / or_one(F.col("std"))
    )
    return both.groupBy("dataset", "column").agg(
        F.max_by("dim", F.struct("shift", -F.col("dim"))).alias("dim"), F.max("shift").alias("shift")
    ).withColumn("shifted", above(F.col("shift"), limit))

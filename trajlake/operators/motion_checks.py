"""Frame-to-frame checks: equality runs, jumps, stuck dims, clock and index order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.numbers import above, finite
from trajlake.functions.vectors import all_finite
from trajlake.operators.blocks import (
    KEYS,
    blocked,
    core,
    episode_lengths,
    shifted,
    spread,
    window,
)
from trajlake.operators.stats import Matrix, difference, matrix, step_scales, with_previous


def longest_frozen_run(frames: DataFrame | Matrix, column: str) -> DataFrame:
    """Longest run of steps that leave the vector unchanged, and its share of the rows.

    Only rows that differ from the one before are kept; a run is the gap
    between two of them. Gaps inside a block come from a window over the block,
    gaps across blocks from one row per block.
    """
    steps = with_previous(frames, column)
    same = (
        F.col("p").isNotNull()
        & (F.col("v") == F.col("p"))
        & ~F.exists("v", F.isnan)
    )
    changes = steps.where(~F.coalesce(same, F.lit(False)))
    gap = F.col("position") - F.lag("position").over(window()) - 1
    per_block = (
        changes.select(*KEYS, "_block", "n", "position", gap.alias("_gap"))
        .groupBy(*KEYS, "_block")
        .agg(
            F.max("n").alias("n"),
            F.max("_gap").alias("_inner"),
            F.min("position").alias("_first"),
            F.max("position").alias("_last"),
        )
    )
    by_block = Window.partitionBy(*KEYS).orderBy("_block")
    edge = F.coalesce(F.lead("_first").over(by_block), F.col("n")) - F.col("_last") - 1
    return (
        per_block.withColumn("_edge", edge)
        .groupBy(*KEYS)
        .agg(
            F.max("n").alias("n"),
            F.greatest(F.coalesce(F.max("_inner"), F.lit(0)), F.max("_edge")).alias("longest_run"),
        )
        .withColumn("frozen_share", F.col("longest_run") / F.col("n"))
    )


def scaled_steps(frames: DataFrame | Matrix, column: str, scales: DataFrame | None = None) -> DataFrame:
    """Each step's ``z``: absolute difference per dim over the dataset's step std.

    ``scales`` is the result of :func:`step_scales` where that is at hand.
    """
    rows, episodes = matrix(frames, column)
    episodes = episodes.join(step_scales(frames, column) if scales is None else scales, "dataset")
    near = blocked(rows, before=1, episodes=episodes)
    near = near.withColumn("p", F.lag("v").over(window())).where(core() & F.col("p").isNotNull())
    z = F.zip_with(difference(F.col("v"), F.col("p")), F.col("scale"), lambda d, s: F.abs(d / s))
    return near.withColumn("z", z)


# Least threshold of the jump checks that :func:`large_steps` serves.
LARGE = 8.0


def large_steps(frames: DataFrame | Matrix, column: str, scales: DataFrame | None = None) -> DataFrame:
    """The scaled steps with any dim over ``LARGE``: all that a jump check of such a threshold can report."""
    steps = scaled_steps(frames, column, scales)
    # NaN is greater than any number here, so no step is lost by it.
    return steps.where(F.exists("z", lambda x: x > LARGE)).select(*KEYS, "position", "n", "v", "p", "z")


def total(values):
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean_jumps(
    frames: DataFrame | Matrix,
    column: str,
    threshold: float = LARGE,
    scales: DataFrame | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Steps whose z averaged over the dims exceeds the threshold, per episode of >=3 rows.

    ``steps`` is the result of :func:`large_steps` where that is at hand; episodes without any are left out then.
    """
    if steps is None or threshold < LARGE:
        steps = scaled_steps(frames, column, scales)
    steps = steps.where(F.col("n") >= 3)
    mean_z = total(F.col("z")) / F.size("z")
    return steps.groupBy(*KEYS).agg(F.count_if(above(mean_z, threshold)).alias("jumps"))


def dimension_jumps(
    frames: DataFrame | Matrix,
    column: str,
    threshold: float = 30.0,
    extreme: float = 40.0,
    min_dims: int = 2,
    report: float = 8.0,
    scales: DataFrame | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Steps where several dims jump together, or one jumps extremely.

    ``steps`` is the result of :func:`large_steps` where that is at hand.
    """
    if steps is None or min(threshold, extreme) < LARGE or min_dims < 1:
        steps = scaled_steps(frames, column, scales)
    over = F.size(F.filter("z", lambda x: above(x, threshold)))
    steps = steps.where(all_finite(F.col("v")) & all_finite(F.col("p")))
    steps = steps.withColumn("max_z", F.array_max("z")).withColumn("dims_over", over)
    hits = steps.where((F.col("dims_over") >= min_dims) | above(F.col("max_z"), extreme))
    reported = F.filter(
        F.transform(F.col("z"), lambda x, i: F.struct(i.alias("dim"), x.alias("z"))),
        lambda e: above(e["z"], report),
    )
    return hits.select(
        *KEYS, "position", "max_z", "dims_over", reported.alias("reported")
    )


def top_per_group(
    events: DataFrame, keys: list[str], order: list, k: int = 5, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group and how many the group has beyond them.

    Ranking with a rank limit is cut down to k rows per group on every task
    before the shuffle, so a long group stays small.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    best = events.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= k)
    sizes = events.groupBy(*keys).agg(F.count("*").alias("events"))
    return best.join(sizes, keys).withColumn(
        "more", F.greatest(F.col("events") - k, F.lit(0))
    )


def stuck_share(frames: DataFrame | Matrix, column: str) -> DataFrame:
    """Per (episode, dim): share of steps that leave the dim unchanged (>=5 rows, varying dims)."""
    # Zipping with a null array would lose the first row, so it gets an empty one.
    none = F.array().cast("array<double>")
    steps = with_previous(frames, column).where(F.col("n") >= 5)
    steps = steps.withColumn("p", F.coalesce("p", none))
    long = steps.select(
        *KEYS, "n", F.posexplode(F.arrays_zip("v", "p")).alias("dim", "_z")
    )
    unchanged = (F.col("_z.v") == F.col("_z.p")) & ~F.isnan(F.col("_z.v"))
    varying = ~F.coalesce(F.min("_z.v") == F.max("_z.v"), F.lit(False))
    return (
        long.groupBy(*KEYS, "dim")
        .agg(
            F.max("n").alias("n"),
            F.count_if(unchanged).alias("unchanged"),
            varying.alias("varies"),
        )
        .where(F.col("varies"))
        .withColumn("share", F.col("unchanged") / (F.col("n") - 1))
        .drop("varies")
    )


def stuck_dims(
    frames: DataFrame, column: str, prepared: Matrix | None = None, lengths: DataFrame | None = None
) -> DataFrame:
    """Dims unchanged in >80% of the steps, in >80% of the dataset's episodes.

    ``lengths`` are the episodes' lengths where they are at hand.
    """
    rows, usable = matrix(prepared or frames, column)
    # Shorter episodes are dropped before their rows are compared.
    stuck = stuck_share(Matrix(rows, usable.where(F.col("n") - 1 > 10)), column).where(F.col("share") > 0.8)
    known = frames if lengths is None else lengths
    episodes = known.groupBy("dataset").agg(F.count_distinct("episode_index").alias("episodes"))
    return (
        stuck.groupBy("dataset", "dim")
        .agg(F.count("*").alias("stuck_episodes"))
        .join(episodes, "dataset")
        .where(F.col("stuck_episodes") > F.col("episodes") * 0.8)
    )


def clock_steps(frames: DataFrame) -> DataFrame:
    """Each frame's time since the previous one (``dt``), null on the first."""
    near = blocked(frames.select(*KEYS, "position", "timestamp"), before=1)
    return near.withColumn(
        "dt", F.col("timestamp") - F.lag("timestamp").over(window())
    ).where(core())


def clock_issues(
    frames: DataFrame, rates: DataFrame, gap: float = 1.5, drift: float = 0.1, lengths: DataFrame | None = None
) -> DataFrame:
    """Per episode: non-monotonic steps, gaps, and the mean interval against 1/fps.

    ``rates`` holds ``(dataset, fps)``; datasets without a positive rate are left out.
    ``lengths`` are the episodes' lengths where they are at hand.
    """
    steps = clock_steps(frames).where(F.col("dt").isNotNull())
    lengths = episode_lengths(frames) if lengths is None else lengths
    episodes = lengths.join(rates.where(F.col("fps") > 0), "dataset")
    interval = 1.0 / F.col("fps")
    timed = steps.drop("_home").join(spread(episodes), [*KEYS, "_block"])
    positive = F.when(above(F.col("dt"), 0), F.col("dt"))
    return (
        timed.groupBy(*KEYS)
        .agg(
            F.max("fps").alias("fps"),
            F.count_if((F.col("dt") <= 0) & ~F.isnan("dt")).alias("non_monotonic"),
            F.count_if(above(F.col("dt"), gap * interval)).alias("gaps"),
            F.avg(positive).alias("mean_interval"),
        )
        .withColumn(
            "drifts",
            F.coalesce(F.abs(F.col("mean_interval") - interval) > interval * drift, F.lit(False)),
        )
    )


def frame_index_mismatches(frames: DataFrame) -> DataFrame:
    """Per episode: rows whose frame_index is not their position, and the first such row."""
    off = frames.where(~F.coalesce(F.col("frame_index") == F.col("position"), F.lit(False)))
    return off.groupBy(*KEYS).agg(
        F.count("*").alias("mismatches"),
        F.min("position").alias("first_position"),
        F.min_by("frame_index", "position").alias("first_value"),
    )


def global_index_breaks(frames: DataFrame) -> DataFrame:
    """Per dataset: places where ``index`` is not one more than on the row before.

    Rows are compared inside blocks; blocks and episodes are chained on their
    first and last values, one row per block.
    """
    near = blocked(frames.select(*KEYS, "position", "index"))
    step = F.col("index") - F.lag("index").over(window())
    per_block = (
        near.withColumn("_step", step)
        .groupBy(*KEYS, "_block")
        .agg(
            F.count_if(F.col("_step") != 1).alias("_inside"),
            F.min_by("index", "position").alias("_first"),
            F.max_by("index", "position").alias("_last"),
        )
    )
    per_episode = Window.partitionBy(*KEYS).orderBy("_block")
    per_block = per_block.withColumn("_prev", F.lag("_last").over(per_episode))
    episodes = per_block.groupBy(*KEYS).agg(
        (F.sum("_inside") + F.count_if(F.col("_prev").isNotNull() & (F.col("_first") != F.col("_prev") + 1))).alias("_breaks"),
        F.min_by("_first", "_block").alias("_first"),
        F.max_by("_last", "_block").alias("_last"),
    )
    chain = shifted(
        episodes.withColumn("_slot", F.floor(F.col("episode_index") / 65536)),
        F.col("_last"),
        ["episode_index"],
        "_slot",
        ["dataset"],
        "_before",
    )
    return chain.groupBy("dataset").agg(
        (
            F.sum("_breaks")
            + F.count_if(F.col("_before").isNotNull() & (F.col("_first") != F.col("_before") + 1))
        ).alias("breaks"),
        F.min_by("_first", "episode_index").alias("first_index"),
    )


def missing_ranges(episodes: DataFrame) -> DataFrame:
    """Runs of absent episode ids between a dataset's smallest and largest id: ``(dataset, first, last, missing)``.

    Gaps are found between neighbouring ids, one row per gap however wide it is. Null
    ids are no ids.
    """
    known = episodes.select(*KEYS).where(F.col("episode_index").isNotNull()).distinct()
    ids = known.withColumn("_slot", F.floor(F.col("episode_index") / 65536))
    gaps = shifted(ids, F.col("episode_index"), ["episode_index"], "_slot", ["dataset"], "_next", ahead=True)
    first, last = F.col("episode_index") + 1, F.col("_next") - 1
    return gaps.where(last >= first).select("dataset", first.alias("first"), last.alias("last"), (last - first + 1).alias("missing"))


def missing_episodes(episodes: DataFrame) -> DataFrame:
    """The absent ids one by one (see :func:`missing_ranges`), for gaps narrow enough to list."""
    step = 65536
    parts = F.sequence(F.col("first"), F.col("last"), F.lit(step).cast("long"))
    slices = missing_ranges(episodes).select("dataset", "last", F.explode(parts).alias("_from"))
    inside = F.sequence(F.col("_from"), F.least(F.col("last"), F.col("_from") + step - 1))
    return slices.select("dataset", F.explode(inside).alias("episode_index"))


def bad_values(frames: DataFrame | Matrix, column: str) -> DataFrame:
    """Per episode: NaN and infinite values in a usable column."""
    rows, episodes = matrix(frames, column)
    near = blocked(rows, episodes=episodes)
    long = near.select(*KEYS, F.explode("v").alias("_x"))
    return (
        long.groupBy(*KEYS)
        .agg(
            F.count_if(F.isnan("_x")).alias("nan_count"),
            F.count_if(~finite(F.col("_x")) & ~F.isnan("_x")).alias("inf_count"),
        )
        .where((F.col("nan_count") > 0) | (F.col("inf_count") > 0))
    )

"""Episode tables: order, scope, sampling, lengths and length histograms."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.numbers import round_half_up
from trajlake.operators.blocks import KEYS, attach, episode_lengths, exact_ranks, positions


def episode_rank(frames: DataFrame) -> DataFrame:
    """Per episode: its 0-based ``rank`` by id and the dataset's number of ``episodes``."""
    ids = frames.select(*KEYS).distinct()
    ranked = positions(ids, ["episode_index"], F.col("episode_index"), ["dataset"], "rank")
    counts = ids.groupBy("dataset").agg(F.count("*").alias("episodes"))
    return ranked.join(counts, "dataset")


def scope(episodes: DataFrame, first: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Episodes with an id in an inclusive range, or the first N by id; a range beats N."""
    if between is not None:
        return episodes.where(F.col("episode_index").between(*between))
    if first is None:
        return episodes
    ranked = positions(episodes, ["episode_index"], F.col("episode_index"), ["dataset"], "_rank")
    return ranked.where(F.col("_rank") < first).drop("_rank")


def only(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    return frames.join(episodes.select(*KEYS).distinct(), KEYS, "left_semi")


def without(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    return frames.join(episodes.select(*KEYS).distinct(), KEYS, "left_anti")


def is_even_sample(position: Column, n: Column, target: int) -> Column:
    """Whether a position is one of ``target`` evenly spread ones, both ends included.

    The i-th pick is round(i*(n-1)/(target-1)). With target < n the picks are at
    least one apart, so none collide and there is never a gap to fill.
    """
    if target <= 1:
        return (position == 0) | (n <= target)
    span = F.greatest(n - 1, F.lit(1))
    guess = F.floor(position * (target - 1) / span + 0.5)

    def pick(i: Column) -> Column:
        return F.floor(i * (n - 1) / (target - 1) + 0.5)

    hit = (pick(guess) == position) | (pick(guess - 1) == position) | (pick(guess + 1) == position)
    return (n <= target) | hit


def even_sample(frames: DataFrame, target: int) -> DataFrame:
    """At most ``target`` evenly spread frames of each episode."""
    out = attach(frames, episode_lengths(frames))
    return out.where(is_even_sample(F.col("position"), F.col("n"), target)).drop("n")


def even_episode_sample(episodes: DataFrame, target: int) -> DataFrame:
    ranked = episode_rank(episodes)
    keep = ranked.where(is_even_sample(F.col("rank"), F.col("episodes"), target))
    return episodes.join(keep.select(*KEYS), KEYS, "left_semi")


def normalised_time(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """Display time i/(n-1)*duration; ``durations`` holds ``duration`` per episode."""
    episodes = episode_lengths(frames).join(durations.select(*KEYS, "duration"), KEYS)
    share = F.col("position") / F.greatest(F.col("n") - 1, F.lit(1))
    return attach(frames, episodes).withColumn("display_time", share * F.col("duration"))


def duration(length: Column, fps: Column, start: Column, end: Column) -> Column:
    """length/fps, or the video span where that is unknown."""
    by_rate = F.when(fps > 0, length / fps)
    return F.coalesce(F.when(length > 0, by_rate), end - start)


def lengths_in_seconds(episodes: DataFrame, fps: Column) -> DataFrame:
    """``n`` frames per episode as ``seconds``, rounded to 2 digits."""
    return episodes.withColumn("seconds", round_half_up(F.col("n") / fps, 2))


def length_stats(episodes: DataFrame) -> DataFrame:
    """Mean, averaged median and population std of ``seconds``, each at 2 digits.

    The std is taken around the rounded mean, as shown to the user.
    """
    mean = episodes.groupBy("dataset").agg(
        F.count("*").alias("episodes"),
        round_half_up(F.avg("seconds"), 2).alias("mean"),
        F.avg("seconds").alias("_m"),
        F.var_pop("seconds").alias("_v"),
        F.min("seconds").alias("shortest"),
        F.max("seconds").alias("longest"),
    )
    n = F.col("n")
    mid = exact_ranks(
        episodes, ["dataset"], "seconds", {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    )
    return mean.join(mid, "dataset").select(
        "dataset",
        "episodes",
        "mean",
        round_half_up((F.col("_low") + F.col("_high")) / 2, 2).alias("median"),
        # E[(x-c)^2] = var + (mean-c)^2 for the rounded centre c.
        round_half_up(F.sqrt(F.col("_v") + (F.col("_m") - F.col("mean")) ** 2), 2).alias("std"),
        "shortest",
        "longest",
    )


def frame_length_stats(episodes: DataFrame, fps: Column) -> DataFrame:
    """Min, max, mean, averaged median and std of episode lengths, in frames and seconds."""
    base = episodes.groupBy("dataset").agg(
        F.count("*").alias("episodes"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
        F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("std"),
    )
    n = F.col("n")
    lengths = episodes.select("dataset", F.col("n").alias("length"))
    mid = exact_ranks(
        lengths, ["dataset"], "length", {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    )
    return (
        base.join(mid.drop("n"), "dataset")
        .withColumn("median", (F.col("_low") + F.col("_high")) / 2)
        .drop("_low", "_high")
        .withColumn("shortest_seconds", F.col("shortest") / fps)
        .withColumn("longest_seconds", F.col("longest") / fps)
        .withColumn("mean_seconds", F.col("mean") / fps)
    )


# Histogram bin widths are one of these times a power of ten.
NICE_STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)


def histogram_bins(episodes: DataFrame) -> DataFrame:
    """Bin layout per dataset from the 1st to the 99th percentile of ``seconds``.

    One zero-width bin when all lengths are equal.
    """
    n = F.col("n")
    edges = exact_ranks(
        episodes,
        ["dataset"],
        "seconds",
        {
            "_p1": F.floor(n * 0.01),
            "_p99": F.ceil(n * 0.99) - 1,
            "_lo": F.lit(0),
            "_hi": n - 1,
        },
    )
    span = F.col("_p99") - F.col("_p1")
    target = F.greatest(F.lit(10.0), F.least(F.lit(50.0), F.ceil(F.log2("n") + 1)))
    out = edges.withColumn("_raw", F.when(span == 0, F.lit(1.0)).otherwise(span) / target)
    out = out.withColumn("_mag", F.pow(F.lit(10.0), F.floor(F.log10("_raw"))))
    nice = F.coalesce(
        *[F.when(F.col("_mag") * s >= F.col("_raw"), F.col("_mag") * s) for s in NICE_STEPS],
        F.col("_raw"),
    )
    out = out.withColumn("width", nice)
    out = out.withColumn("minimum", F.floor(F.col("_p1") / F.col("width")) * F.col("width"))
    top = F.ceil(F.col("_p99") / F.col("width")) * F.col("width")
    count = F.greatest(F.lit(1), F.floor((top - F.col("minimum")) / F.col("width") + 0.5))
    same = F.col("_lo") == F.col("_hi")
    return out.withColumn("bins", count.cast("int")).select(
        "dataset",
        F.when(same, F.col("_lo")).otherwise(F.col("minimum")).alias("minimum"),
        F.when(same, F.lit(0.0)).otherwise(F.col("width")).alias("width"),
        F.when(same, F.lit(1)).otherwise(F.col("bins")).alias("bins"),
    )


def bin_of(value: Column, minimum: Column, width: Column, bins: Column) -> Column:
    """Bin number with out-of-range values put in the first or last bin."""
    raw = F.floor(F.try_divide(value - minimum, F.when(width > 0, width)))
    return F.coalesce(F.greatest(F.lit(0), F.least(bins - 1, raw)), F.lit(0)).cast("int")


def histogram(episodes: DataFrame, bins: DataFrame) -> DataFrame:
    """Episode counts per bin, empty bins kept."""
    lengths = episodes.groupBy("dataset", "seconds").agg(F.count("*").alias("_c"))
    number = bin_of(F.col("seconds"), F.col("minimum"), F.col("width"), F.col("bins"))
    counts = (
        lengths.join(bins, "dataset")
        .withColumn("bin", number)
        .groupBy("dataset", "bin")
        .agg(F.sum("_c").alias("episodes"))
    )
    every = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    lo = F.col("minimum") + F.col("bin") * F.col("width")
    return every.join(counts, ["dataset", "bin"], "left").select(
        "dataset",
        "bin",
        lo.alias("low"),
        (lo + F.col("width")).alias("high"),
        F.coalesce("episodes", F.lit(0)).alias("episodes"),
    )


def bin_members(episodes: DataFrame, bins: DataFrame) -> DataFrame:
    """One row per episode with its bin and its place in the bin by ascending id.

    Rows instead of one list per bin, as a bin can hold a third of the episodes.
    An empty bin keeps one row without an episode.
    """
    number = bin_of(F.col("seconds"), F.col("minimum"), F.col("width"), F.col("bins"))
    placed = episodes.join(bins, "dataset").withColumn("bin", number).select("dataset", "bin", "episode_index")
    placed = positions(placed, ["episode_index"], F.col("episode_index"), ["dataset", "bin"], "place")
    every = bins.select("dataset", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(placed, ["dataset", "bin"], "left")


def outside_range(episodes: DataFrame, low: float, high: float) -> DataFrame:
    """Episodes whose ``seconds`` fall outside [low, high]."""
    return episodes.where((F.col("seconds") < low) | (F.col("seconds") > high))


def extremes(episodes: DataFrame, k: int = 5) -> DataFrame:
    """The k shortest and k longest episodes of each dataset, ranked."""
    out = None
    for name, order in (
        ("shortest", [F.asc("seconds"), F.asc("episode_index")]),
        ("longest", [F.desc("seconds"), F.desc("episode_index")]),
    ):
        over = Window.partitionBy("dataset").orderBy(*order)
        part = (
            episodes.withColumn("rank", F.row_number().over(over))
            .where(F.col("rank") <= k)
            .select("dataset", F.lit(name).alias("side"), "rank", "episode_index", "seconds")
        )
        out = part if out is None else out.unionByName(part)
    return out

"""Cross-episode statistics of an action column and its match with the state.

All functions work on every dataset of the table at once. Use
:func:`each_episode` to get the same answers for every episode by itself. Rows
without a vector have no place in these statistics: where a column has such
rows, number the others with :func:`present` first.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.numbers import or_one, round_half_up
from trajlake.functions.vectors import fit, quoted
from trajlake.operators.blocks import KEYS, blocked, core, exact_ranks, positions, window
from trajlake.session import block_rows

# Fixed thresholds.
ACTIVITY_SHARE = 0.001
DISCRETE_VALUES = 4
VELOCITY_BINS = 30
MAX_ACF_LAG = 100
MAX_ALIGN_LAG = 30
CHUNK_ACF = 0.5


def each_episode(frames: DataFrame) -> DataFrame:
    """Make every episode a dataset of its own, named ``dataset#episode``."""
    name = F.concat_ws("#", "dataset", F.col("episode_index").cast("string"))
    return frames.withColumn("dataset", name)


def present(frames: DataFrame, column: str = "action") -> DataFrame:
    """Drop rows without a vector and number the others from 0 again."""
    kept = frames.where(quoted(column).isNotNull()).drop("frame_index")
    kept = kept.withColumnRenamed("position", "frame_index")
    return positions(kept, ["frame_index"], F.col("frame_index"))


def action_episodes(frames: DataFrame, column: str = "action") -> DataFrame:
    """Per episode ``n`` rows that hold a vector, and the dataset's vector width ``dims``."""
    per = (
        frames.where(quoted(column).isNotNull())
        .groupBy(*KEYS)
        .agg(F.count("*").alias("n"), F.max(F.size(quoted(column))).alias("_w"))
    )
    dims = per.groupBy("dataset").agg(F.max("_w").alias("dims"))
    return per.drop("_w").join(dims, "dataset")


def action_rows(frames: DataFrame, column: str = "action") -> DataFrame:
    return frames.where(quoted(column).isNotNull()).select(
        *KEYS, "position", quoted(column).cast("array<double>").alias("v")
    )


def steps(frames: DataFrame, episodes: DataFrame, column: str = "action") -> DataFrame:
    """Long form ``(keys, position, dim, x, d)``: value and change since the row before.

    Missing values count as 0. ``d`` is null on an episode's first row. Columns
    of ``episodes`` come along; array columns are split by dim under their name.
    """
    arrays = [f.name for f in episodes.schema.fields if f.dataType.typeName() == "array"]
    plain = [c for c in episodes.columns if c not in arrays and c not in KEYS]
    near = blocked(action_rows(frames, column), before=1, episodes=episodes)
    near = near.withColumn("v", fit(F.col("v"), F.col("dims")))
    # Zipping with a null array would lose the first row, so it gets an empty one.
    none = F.array().cast("array<double>")
    near = near.withColumn("p", F.coalesce(F.lag("v").over(window()), none)).where(core())
    zipped = F.posexplode(F.arrays_zip("v", "p", *arrays)).alias("dim", "_z")
    first = F.col("position") == 0
    x = F.coalesce(F.col("_z.v"), F.lit(0.0))
    return near.select(*KEYS, "_block", "position", *plain, zipped).select(
        *KEYS,
        "_block",
        "position",
        *plain,
        "dim",
        x.alias("x"),
        F.when(~first, x - F.coalesce(F.col("_z.p"), F.lit(0.0))).alias("d"),
        *[F.col(f"_z.{a}").alias(a) for a in arrays],
    )


def by_dim(table: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """Fold (keys, dim) rows into arrays in dim order; bounded by the vector width."""
    packed = F.sort_array(F.collect_list(F.struct("dim", *[c.alias(k) for k, c in columns.items()])))
    return table.groupBy(*keys).agg(packed.alias("_all")).select(
        *keys, *[F.col(f"_all.{k}").alias(k) for k in columns]
    )


def time_variance(frames: DataFrame, bins: int = 50, column: str = "action") -> DataFrame:
    """Population variance over episodes at evenly spaced relative times.

    Bin b of an episode reads row round(b/(bins-1)*(n-1)). Each row works out
    which bins it serves, so only partial sums are shuffled.
    """
    near = blocked(action_rows(frames, column), episodes=action_episodes(frames, column))
    last = F.col("n") - 1
    span = F.greatest(last, F.lit(1))
    pos = F.col("position")
    low = F.floor((pos - 0.5) * (bins - 1) / span) - 1
    high = F.ceil((pos + 0.5) * (bins - 1) / span) + 1
    served = F.sequence(
        F.when(last == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), low)).cast("int"),
        F.when(last == 0, F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 1), high)).cast("int"),
    )
    picks = near.select(*KEYS, "position", "n", fit(F.col("v"), F.col("dims")).alias("v"), F.explode(served).alias("bin"))
    source = F.least(F.floor(F.col("bin") / (bins - 1.0) * last + 0.5), last)
    long = picks.where(source == pos).select("dataset", "bin", F.posexplode("v").alias("dim", "_x"))
    x = F.coalesce("_x", F.lit(0.0))
    return long.groupBy("dataset", "bin", "dim").agg(
        F.count("*").alias("episodes"), F.var_pop(x).alias("variance")
    ).withColumn("variance", F.when(F.col("episodes") < 2, F.lit(0.0)).otherwise(F.col("variance")))


def movement(frames: DataFrame, column: str = "action") -> DataFrame:
    """Mean length of the action change per step, per episode, at 4 digits."""
    episodes = action_episodes(frames, column)
    near = blocked(action_rows(frames, column), before=1, episodes=episodes)
    near = near.withColumn("v", fit(F.col("v"), F.col("dims")))
    near = near.withColumn("p", F.lag("v").over(window())).where(core())
    squares = F.aggregate(
        F.zip_with(
            "v", "p", lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))
        ),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )
    step = F.when(F.col("p").isNotNull(), F.sqrt(squares))
    return near.groupBy(*KEYS).agg(
        F.max("n").alias("n"),
        round_half_up(F.coalesce(F.avg(step), F.lit(0.0)), 4).alias("movement"),
    )


def lowest(scores: DataFrame, by: str, k: int, descending: bool = False) -> DataFrame:
    """The k best rows per dataset, ties by episode id."""
    order = [F.desc(by) if descending else F.asc(by), F.asc("episode_index")]
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def motor_ranges(frames: DataFrame, column: str = "action") -> DataFrame:
    """Per (dataset, dim): value range (0 becomes 1) and whether <=4 distinct values occur.

    Plain aggregates over slices of ``block_rows`` frames; no row meets its neighbours.
    Distinct values are cut to five per slice before they are shuffled: more than four
    is all that needs to be known.
    """
    slice_of = F.floor(F.col("position") / block_rows())
    long = (
        action_rows(frames, column)
        .join(action_episodes(frames, column), KEYS)
        .select(*KEYS, slice_of.alias("_slice"), F.posexplode(fit(F.col("v"), F.col("dims"))).alias("dim", "_x"))
        .withColumn("x", F.coalesce("_x", F.lit(0.0)))
    )
    few = F.slice(F.array_sort(F.collect_set("x")), 1, DISCRETE_VALUES + 1)
    per_slice = long.groupBy(*KEYS, "_slice", "dim").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), few.alias("_few"))
    ranges = per_slice.groupBy("dataset", "dim").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    values = (
        per_slice.select("dataset", "dim", F.explode("_few").alias("_x"))
        .groupBy("dataset", "dim", "_x").agg(F.lit(1))
        .groupBy("dataset", "dim").agg(F.count("*").alias("_values"))
    )
    return ranges.join(values, ["dataset", "dim"]).select(
        "dataset",
        "dim",
        "lo",
        "hi",
        or_one(F.col("hi") - F.col("lo")).alias("motor_range"),
        F.least("_values", F.lit(DISCRETE_VALUES + 1)).cast("int").alias("distinct_values"),
        (F.col("_values") <= DISCRETE_VALUES).alias("discrete"),
    )


def activity(frames: DataFrame, ranges: DataFrame, column: str = "action") -> DataFrame:
    """Per (episode, dim): is the 95th percentile step at least 0.1% of the motor range?

    The percentile is sorted[floor(m*0.95)], so it reaches the limit exactly
    when no more than that many steps are below it: counting is enough.
    """
    folded = by_dim(ranges, ["dataset"], motor_range=F.col("motor_range"))
    episodes = action_episodes(frames, column).join(folded, "dataset")
    long = steps(frames, episodes, column)
    small = F.count_if(F.abs("d") < F.col("motor_range") * ACTIVITY_SHARE)
    out = long.groupBy(*KEYS, "dim").agg(
        F.max("n").alias("n"),
        F.count("d").alias("steps"),
        small.alias("_small"),
        F.sum(F.abs("d") / F.col("motor_range")).alias("scaled_path"),
    )
    active = (F.col("n") >= 2) & (F.col("_small") <= F.floor(F.col("steps") * 0.95))
    return out.withColumn("active", active).drop("_small")


def inactive_motors(active: DataFrame) -> DataFrame:
    """Dims that are active in no episode."""
    return active.groupBy("dataset", "dim").agg((~F.bool_or("active")).alias("inactive"))


def jerkiness(active: DataFrame) -> DataFrame:
    """Mean |step|/range over the dims active in the episode; 0 when none is."""
    on = F.col("active")
    return active.groupBy(*KEYS).agg(
        F.coalesce(
            F.try_divide(F.sum(F.when(on, F.col("scaled_path"))), F.sum(F.when(on, F.col("steps")))),
            F.lit(0.0),
        ).alias("jerkiness")
    )


def velocity_stats(
    frames: DataFrame, ranges: DataFrame, active: DataFrame, column: str = "action"
) -> tuple[DataFrame, DataFrame]:
    """Step statistics per dim over the active episodes (all, if none is), and 30-bin counts.

    Returns ``(stats, bins)``; everything is divided by the motor range.
    """
    dead = inactive_motors(active)
    used = active.join(dead, ["dataset", "dim"]).select(
        *KEYS, "dim", (F.col("active") | F.col("inactive")).alias("used")
    )
    per_motor = by_dim(ranges, ["dataset"], motor_range=F.col("motor_range"))
    per_episode = by_dim(used, KEYS, used=F.col("used"))
    episodes = action_episodes(frames, column).join(per_motor, "dataset").join(per_episode, KEYS)
    kept = steps(frames, episodes, column).where(F.col("used") & F.col("d").isNotNull())
    scaled = kept.withColumn("_v", F.col("d") / F.col("motor_range"))
    stats = (
        scaled.groupBy("dataset", "dim")
        .agg(
            F.stddev_pop("_v").alias("std"),
            F.max(F.abs("_v")).alias("max_abs"),
            F.min("_v").alias("lo"),
            F.max("_v").alias("hi"),
            F.count("*").alias("steps"),
        )
    )
    out = (
        ranges.select("dataset", "dim", "motor_range", "discrete")
        .join(dead, ["dataset", "dim"], "left")
        .join(stats, ["dataset", "dim"], "left")
        .na.fill(0.0, ["std", "max_abs", "lo", "hi"])
        .na.fill(0, ["steps"])
        .na.fill(True, ["inactive"])
    )
    layout = by_dim(stats, ["dataset"], lo=F.col("lo"), hi=F.col("hi"))
    binned = steps(frames, episodes.join(layout, "dataset"), column).where(
        F.col("used") & F.col("d").isNotNull()
    )
    width = or_one(F.col("hi") - F.col("lo")) / VELOCITY_BINS
    number = F.least(
        F.floor((F.col("d") / F.col("motor_range") - F.col("lo")) / width), F.lit(VELOCITY_BINS - 1)
    )
    bins = binned.withColumn("bin", number.cast("int")).groupBy("dataset", "dim", "bin").agg(
        F.count("*").alias("steps")
    )
    return out, bins


def autocorrelation(frames: DataFrame, max_lag: int = MAX_ACF_LAG, column: str = "action") -> DataFrame:
    """Mean over episodes of each dim's autocorrelation at lags 1..L.

    An episode takes part in the lags up to half its length, if that is 2 or more,
    and at most ``max_lag``; ``episodes`` says how many took part. A dim that is
    constant in an episode adds 0 there. Look-ahead stays inside a block plus
    ``max_lag`` copied rows.
    """
    episodes = action_episodes(frames, column)
    means = (
        blocked(action_rows(frames, column), episodes=episodes)
        .select(*KEYS, F.posexplode(fit(F.col("v"), F.col("dims"))).alias("dim", "_x"))
        .groupBy(*KEYS, "dim")
        .agg(F.avg(F.coalesce("_x", F.lit(0.0))).alias("m"))
    )
    limit = episodes.select(*KEYS, F.least(F.lit(max_lag), F.floor(F.col("n") / 2)).alias("_lags")).where("_lags >= 2")
    near = blocked(
        action_rows(frames, column),
        after=max_lag,
        episodes=episodes.join(by_dim(means, KEYS, m=F.col("m")), KEYS),
    )
    vectors = near.select(
        *KEYS,
        "_block",
        core().alias("_own"),
        "position",
        F.transform(fit(F.col("v"), F.col("dims")), lambda x: F.coalesce(x, F.lit(0.0))).alias("v"),
        "m",
    )
    sums = (
        vectors.groupBy(*KEYS, "_block")
        .applyInPandas(
            lag_products(max_lag),
            "dataset string, episode_index long, dim int, lag int, total double, lo double, hi double",
        )
        .groupBy(*KEYS, "dim", "lag")
        .agg(F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    base = sums.where("lag = 0").select(*KEYS, "dim", F.col("total").alias("_l0"))
    varying = (F.col("lo") < F.col("hi")) & (F.col("_l0") > 0)
    ratio = F.when(varying, F.try_divide(F.col("total"), F.col("_l0"))).otherwise(F.lit(0.0))
    return (
        sums.where("lag > 0")
        .join(base, [*KEYS, "dim"])
        .join(limit, KEYS)
        .where(F.col("lag") <= F.col("_lags"))
        .groupBy("dataset", "dim", "lag")
        .agg(F.avg(ratio).alias("acf"), F.count("*").alias("episodes"))
    )


def lag_products(max_lag: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums of products of one block's centred rows with the rows 0..max_lag later."""

    def products(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        own = int(block["_own"].sum())  # the copied rows come after the block's own
        values = np.stack(block["v"].to_numpy())
        centred = values - block["m"].iloc[0]
        lags, dims = np.arange(max_lag + 1), values.shape[1]
        total = np.zeros((len(lags), dims))
        for k in lags:
            m = min(own, len(centred) - k)
            if m > 0:
                total[k] = np.einsum("td,td->d", centred[:m], centred[k : k + m])
        return pd.DataFrame(
            {
                "dataset": block["dataset"].iloc[0],
                "episode_index": block["episode_index"].iloc[0],
                "dim": np.tile(np.arange(dims, dtype="int32"), len(lags)),
                "lag": np.repeat(lags.astype("int32"), dims),
                "total": total.ravel(),
                "lo": np.tile(values[:own].min(axis=0), len(lags)),
                "hi": np.tile(values[:own].max(axis=0), len(lags)),
            }
        )

    return products


def suggested_chunk(acf: DataFrame) -> DataFrame:
    """Upper median over dims of the first lag whose autocorrelation is below 0.5."""
    first = (
        acf.where(F.col("acf") < CHUNK_ACF).groupBy("dataset", "dim").agg(F.min("lag").alias("_lag"))
    )
    sorted_lags = F.sort_array(F.collect_list("_lag"))  # one value per dim
    found = first.groupBy("dataset").agg(sorted_lags.alias("_lags"))
    chunk = F.element_at("_lags", (F.floor(F.size("_lags") / 2) + 1).cast("int"))
    return acf.select("dataset").distinct().join(
        found.select("dataset", chunk.alias("suggested_chunk")), "dataset", "left"
    )


def pair_dims(action_names: DataFrame, state_names: DataFrame) -> DataFrame:
    """Pair action dims with state dims by name; by index where no name matches.

    Inputs are ``(dataset, dim, name)``; the first state dim of a name is used.
    """
    states = state_names.groupBy("dataset", "name").agg(F.min("dim").alias("state_dim"))
    named = action_names.withColumnRenamed("dim", "action_dim").join(states, ["dataset", "name"])
    named = named.select("dataset", "action_dim", "state_dim")
    by_index = action_names.select("dataset", F.col("dim").alias("action_dim"), F.col("dim").alias("state_dim")).join(
        state_names.select("dataset", F.col("dim").alias("state_dim")), ["dataset", "state_dim"]
    )
    rest = by_index.join(named.select("dataset").distinct(), "dataset", "left_anti")
    return named.unionByName(rest.select("dataset", "action_dim", "state_dim"))


def cross_correlation(
    frames: DataFrame,
    pairs: DataFrame,
    max_lag: int = MAX_ALIGN_LAG,
    action: str = "action",
    state: str = "observation.state",
    quarter_limit: bool = False,
) -> DataFrame:
    """Correlation of action steps with state steps at lags -L..L per pair, averaged over episodes.

    Episodes under 10 rows are left out. ``quarter_limit`` also holds the lag
    to a quarter of the episode, as for a single episode.
    """
    ordered = F.sort_array(F.collect_list(F.struct("action_dim", "state_dim")))
    folded = pairs.groupBy("dataset").agg(ordered.alias("_pairs"))
    both = frames.where(quoted(action).isNotNull() & quoted(state).isNotNull())
    rows = both.select(
        *KEYS,
        "position",
        quoted(action).cast("array<double>").alias("_a"),
        quoted(state).cast("array<double>").alias("_s"),
    )
    ends = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.min_by("_a", "position").alias("_a0"),
        F.max_by("_a", "position").alias("_a1"),
        F.min_by("_s", "position").alias("_s0"),
        F.max_by("_s", "position").alias("_s1"),
    )
    ends = ends.where(F.col("n") >= 10).join(folded, "dataset")

    def at(v, d):
        return F.coalesce(F.get(v, d), F.lit(0.0))

    def mean_step(last, first, field):
        # The mean of the steps is the whole change over their number.
        return F.transform(
            "_pairs",
            lambda p: (at(F.col(last), p[field]) - at(F.col(first), p[field])) / (F.col("n") - 1),
        )

    episodes = ends.select(
        *KEYS,
        "n",
        "_pairs",
        mean_step("_a1", "_a0", "action_dim").alias("_am"),
        mean_step("_s1", "_s0", "state_dim").alias("_sm"),
    )
    near = blocked(rows, before=max_lag + 1, after=max_lag, episodes=episodes)
    values = near.select(
        *KEYS,
        "_block",
        core().alias("_own"),
        "position",
        "n",
        F.transform("_pairs", lambda p: at(F.col("_a"), p["action_dim"])).alias("a"),
        F.transform("_pairs", lambda p: at(F.col("_s"), p["state_dim"])).alias("s"),
        "_am",
        "_sm",
    )
    long = (
        values.groupBy(*KEYS, "_block")
        .applyInPandas(
            step_products(max_lag),
            "dataset string, episode_index long, n long, pair int, lag int, xy double, xx double, yy double",
        )
        .groupBy(*KEYS, "pair", "lag")
        .agg(
            F.max("n").alias("n"),
            F.sum("xy").alias("x"),
            F.sqrt(F.sum("xx") * F.sum("yy")).alias("d"),
        )
    )
    allowed = F.lit(max_lag)
    if quarter_limit:
        allowed = F.least(allowed, F.floor(F.col("n") / 4))
        long = long.where(allowed >= 2)
    r = F.when(F.col("d") > 0, F.col("x") / F.col("d"))
    return (
        long.where(F.abs("lag") <= allowed)
        .groupBy("dataset", "pair", "lag")
        .agg(F.coalesce(F.avg(r), F.lit(0.0)).alias("correlation"))
    )


def step_products(max_lag: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums over one block's steps with the state steps -max_lag..max_lag away.

    A lag only counts the steps that have a partner, in the squares as well.
    """

    def products(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        own = block["_own"].to_numpy(bool)[1:]  # whether the row a step ends on is the block's own
        x = np.diff(np.stack(block["a"].to_numpy()), axis=0) - block["_am"].iloc[0]
        y = np.diff(np.stack(block["s"].to_numpy()), axis=0) - block["_sm"].iloc[0]
        lags = np.arange(-max_lag, max_lag + 1)
        pairs = len(block["_am"].iloc[0])
        out = np.zeros((3, len(lags), pairs))
        at = np.flatnonzero(own)
        for i, k in enumerate(lags):
            here = at[(at + k >= 0) & (at + k < len(y))]
            if len(here):
                a, s = x[here], y[here + k]
                out[:, i] = (a * s).sum(0), (a * a).sum(0), (s * s).sum(0)
        return pd.DataFrame(
            {
                "dataset": block["dataset"].iloc[0],
                "episode_index": block["episode_index"].iloc[0],
                "n": block["n"].iloc[0],
                "pair": np.tile(np.arange(pairs, dtype="int32"), len(lags)),
                "lag": np.repeat(lags.astype("int32"), pairs),
                "xy": out[0].ravel(),
                "xx": out[1].ravel(),
                "yy": out[2].ravel(),
            }
        )

    return products


def alignment_envelope(correlation: DataFrame) -> DataFrame:
    """Max, mean and min over pairs at every lag."""
    return correlation.groupBy("dataset", "lag").agg(
        F.max("correlation").alias("max"),
        F.avg("correlation").alias("mean"),
        F.min("correlation").alias("min"),
    )


def alignment_peaks(correlation: DataFrame) -> DataFrame:
    """Peak lag and value of each envelope curve, and the range of the pairs' own peaks.

    Of equal values the smallest lag is the peak.
    """

    def peak(value):
        return F.max_by("lag", F.struct(F.col(value), -F.col("lag")))

    curves = alignment_envelope(correlation).groupBy("dataset").agg(
        *[peak(c).alias(f"{c}_peak_lag") for c in ("mean", "max", "min")],
        *[F.max(c).alias(f"{c}_peak") for c in ("mean", "max", "min")],
    )
    own = correlation.groupBy("dataset", "pair").agg(peak("correlation").alias("_lag"))
    spans = own.groupBy("dataset").agg(
        F.min("_lag").alias("lag_low"), F.max("_lag").alias("lag_high"), F.count("*").alias("pairs")
    )
    return curves.join(spans, "dataset")


def speed_distribution(scores: DataFrame) -> DataFrame:
    """Spread of the movement scores with a verdict; datasets of >=3 episodes."""
    base = scores.groupBy("dataset").agg(
        F.count("*").alias("episodes"),
        F.avg("movement").alias("mean"),
        F.stddev_pop("movement").alias("std"),
        F.min("movement").alias("lo"),
        F.max("movement").alias("hi"),
    ).where(F.col("episodes") >= 3)
    n = F.col("n")
    mid = exact_ranks(scores.select("dataset", "movement"), ["dataset"], "movement", {"median": F.floor(n / 2)})
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0))
    out = base.join(mid.drop("n"), "dataset").withColumn("cv", cv)
    bins = F.least(F.lit(30), F.ceil(F.sqrt("episodes")))
    return (
        out.withColumn("bins", bins.cast("int"))
        .withColumn("bin_width", or_one(F.col("hi") - F.col("lo")) / F.col("bins"))
        .withColumn(
            "verdict",
            F.when(F.col("cv") < 0.2, "consistent").when(F.col("cv") < 0.4, "moderate").otherwise("high"),
        )
    )


def speed_histogram(scores: DataFrame, layout: DataFrame) -> DataFrame:
    number = F.least(
        F.floor((F.col("movement") - F.col("lo")) / F.col("bin_width")), F.col("bins") - 1
    ).cast("int")
    same = scores.groupBy("dataset", "movement").agg(F.count("*").alias("_c"))
    return (
        same.join(layout.select("dataset", "lo", "bin_width", "bins"), "dataset")
        .groupBy("dataset", number.alias("bin"))
        .agg(F.sum("_c").alias("episodes"))
    )


def smoothness(stats: DataFrame, names: DataFrame) -> DataFrame:
    """Verdict from each dim's step std over the largest; grippers may be jerky.

    ``names`` is ``(dataset, dim, name)``. Inactive and discrete dims are left out.
    """
    used = stats.where(~F.col("inactive") & ~F.col("discrete")).join(names, ["dataset", "dim"], "left")
    top = used.groupBy("dataset").agg(F.max("std").alias("_top"))
    share = F.try_divide(F.col("std"), F.col("_top"))
    gripper = F.coalesce(F.lower("name").contains("grip"), F.lit(False))
    counts = used.join(top, "dataset").groupBy("dataset").agg(
        F.count("*").alias("active"),
        F.count_if(share < 0.4).alias("smooth"),
        F.count_if((share >= 0.4) & (share < 0.7)).alias("moderate"),
        F.count_if(share >= 0.7).alias("jerky"),
        F.count_if((share >= 0.7) & ~gripper).alias("jerky_joints"),
    )
    ratio = F.try_divide(F.col("smooth"), F.col("active"))
    verdict = (
        F.when(F.coalesce("active", F.lit(0)) == 0, "na")
        .when((ratio >= 0.6) & (F.col("jerky_joints") == 0), "smooth")
        .when((F.col("jerky_joints") <= 2) & (ratio >= 0.3), "moderate")
        .otherwise("jerky")
    )
    return (
        stats.select("dataset").distinct().join(counts, "dataset", "left")
        .withColumn("verdict", verdict)
        .na.fill(0)
    )

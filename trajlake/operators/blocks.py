"""Splitting long episodes into blocks, so no window holds a whole episode.

Every frame table carries ``dataset, episode_index, position`` where position
is the dense 0-based place of the frame in its episode. A block is a run of
positions; a window over a block sees its neighbours through *halo* rows, the
few rows on the other side of a block edge that are copied into the block.
Results are the same as over the whole episode, whatever the block size.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajlake.session import block_rows, cut, split_rows

KEYS = ["dataset", "episode_index"]


def positions(
    df: DataFrame,
    order: list[str | Column],
    split_on: Column,
    keys: list[str] = KEYS,
    name: str = "position",
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``.

    A group longer than the split limit is first cut into slices of ``split_on``
    (any expression that never decreases along ``order``); each slice is
    numbered by itself and shifted by the rows of the slices before it. Long groups are
    looked for as the plan is made; where there are none, rows move once.
    """
    base = df.withColumn("_x", split_on.cast("double"))
    found = long_groups(base, keys, split_rows())
    if found is None:
        within = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(within) - 1).cast("long"))
    slot = F.floor(
        F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * F.col("_slices")
    )
    sliced = base.join(found, keys, "left").withColumn(
        "_slice", F.coalesce(slot, F.lit(0)).cast("long")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        base.join(found, keys)
        .withColumn("_slice", F.coalesce(slot, F.lit(0)).cast("long"))
        .groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(shifts, [*keys, "_slice"], "left")
        .withColumn(
            name,
            (F.row_number().over(within) - 1 + F.coalesce("_shift", F.lit(0))).cast("long"),
        )
        .drop("_x", "_lo", "_hi", "_slices", "_slice", "_shift")
    )


# Slots of key hashes by which groups that may be long are found; a slot holds many groups.
SLOTS = 65_536


def long_groups(base: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Groups of more than ``limit`` rows with the range of ``_x`` and their ``_slices``; None where there are none.

    Rows are counted per slot of the keys' hash first, which moves next to nothing. A long
    group's slot holds over ``limit`` rows too, so only groups in such slots are counted.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    full = base.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_slot").collect()
    if not full:
        return None
    slots = base.sparkSession.createDataFrame([(r._slot,) for r in full], "_slot int")
    counted = (
        base.select(*keys, "_x", slot.alias("_slot"))
        .join(F.broadcast(slots), "_slot", "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        .where(F.col("_n") > limit)
    )
    found = cut(counted.select(*keys, "_lo", "_hi", F.ceil(F.col("_n") * 4 / limit).alias("_slices")))
    return None if found.isEmpty() else found


def episode_lengths(frames: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per episode: ``n`` frames and any further aggregates."""
    return frames.groupBy(*KEYS).agg(F.count("*").alias("n"), *aggregates)


def spread(episodes: DataFrame, size: int | None = None) -> DataFrame:
    """One row per (episode, block), from the frame count ``n``.

    Joining frames to this on the block keeps a long episode in many tasks, and
    leaves the rows placed as the block windows want them.
    """
    size = size or block_rows()
    last = F.greatest(F.floor((F.col("n") - 1) / size), F.lit(0))
    return episodes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))


def home_block(size: int | None = None) -> Column:
    return F.floor(F.col("position") / (size or block_rows())).cast("long")


def blocked(
    frames: DataFrame,
    before: int = 0,
    after: int = 0,
    episodes: DataFrame | None = None,
) -> DataFrame:
    """Add ``_block`` and ``_home``; copy halo rows; attach per-episode columns.

    ``before``/``after`` say how many rows a window looks back and ahead.
    Rows with ``_block != _home`` are the copies; see :func:`core`.
    """
    size = max(block_rows(), before, after, 1)
    out = frames.withColumn("_home", home_block(size))
    at = F.pmod(F.col("position"), F.lit(size))
    targets = [F.col("_home")]
    if before:
        targets.append(F.when(at >= size - before, F.col("_home") + 1))
    if after:
        targets.append(F.when((at < after) & (F.col("_home") > 0), F.col("_home") - 1))
    if len(targets) > 1:
        out = out.withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    else:
        out = out.withColumn("_block", F.col("_home"))
    if episodes is not None:
        placed = spread(episodes, size)
        if len(targets) > 1:
            # Work per block follows, so the rows have to move to their block anyway:
            # they move once, here, and the join and the windows use it. Without a number of
            # tasks Spark may still merge or split them by size.
            out = out.repartition(*KEYS, "_block")
            placed = placed.hint("merge")
        out = out.join(placed, [*KEYS, "_block"])
    return out


def attach(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add per-episode columns (which must include ``n``) to every frame."""
    return blocked(frames, episodes=episodes).drop("_block", "_home")


def core() -> Column:
    return F.col("_block") == F.col("_home")


def window(*extra: str) -> WindowSpec:
    return Window.partitionBy(*KEYS, "_block", *extra).orderBy("position")


def shifted(
    df: DataFrame,
    value: Column,
    order: list[str],
    block: str,
    keys: list[str],
    name: str,
    ahead: bool = False,
) -> DataFrame:
    """The previous (or next) row's ``value`` for rows in any order.

    ``block`` is a column that never decreases along ``order``. Inside a block
    this is a plain lag; the row at a block's edge takes the value kept for the
    neighbouring block, found on a table with one row per block.
    """
    packed = F.struct(value.alias("v"))
    step = F.lead if ahead else F.lag
    edge_key = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    edges = df.groupBy(*keys, block).agg(pick(packed, edge_key).alias("_edge"))
    over_blocks = Window.partitionBy(*keys).orderBy(block)
    edges = edges.select(*keys, block, step("_edge").over(over_blocks).alias("_edge"))
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    return (
        df.join(edges, [*keys, block], "left")
        .withColumn(name, F.coalesce(step(packed).over(inside), F.col("_edge"))["v"])
        .drop("_edge")
    )


def as_of(
    rows: DataFrame,
    marks: DataFrame,
    at: str,
    value: str,
    width: float,
    keys: list[str] = KEYS,
    tie: list[str] | None = None,
) -> DataFrame:
    """Give each row the ``value`` of the last mark with mark.at <= row.at.

    Both sides are cut into stretches of ``width`` along ``at``. A mark is also
    carried to the start of each later stretch up to the next mark, so every
    stretch is answered by itself. Equal ``at``: the mark that sorts last by
    ``tie`` wins.
    """
    stretch = F.floor(F.col(at) / width).cast("long")
    spans = rows.groupBy(*keys).agg(F.max(stretch).alias("_last"))
    tie = tie or []
    placed = marks.withColumn("_stretch", stretch)
    nexts = shifted(
        placed.select(*keys, at, value, "_stretch", *tie),
        F.col("_stretch"),
        [at, *tie],
        "_stretch",
        keys,
        "_next",
        ahead=True,
    )
    carried = nexts.join(spans, keys).withColumn(
        "_stretch",
        F.explode(
            F.sequence(
                F.col("_stretch"),
                F.greatest(
                    F.col("_stretch"),
                    F.least(F.col("_last"), F.coalesce("_next", F.col("_last"))),
                ),
            )
        ),
    )
    order_cols = [F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)]
    events = carried.select(
        *keys,
        "_stretch",
        F.col(at).alias("_at"),
        F.struct(F.col(value).alias("v")).alias("_mark"),
        *order_cols,
        F.lit(0).alias("_kind"),
    )
    probes = rows.withColumn("_stretch", stretch).select(
        *keys,
        "_stretch",
        F.col(at).alias("_at"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"),
        F.lit(1).alias("_kind"),
    )
    order = ["_at", "_kind", *[f"_t{i}" for i in range(len(tie))]]
    seen = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        events.unionByName(probes, allowMissingColumns=True)
        .withColumn("_mark", F.last("_mark", ignorenulls=True).over(seen))
        .where(F.col("_kind") == 1)
        .select("_row.*", F.col("_mark.v").alias(value))
    )


def exact_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Pick order statistics: ``ranks`` maps a name to a 0-based rank in terms of ``n``.

    Equal values are counted together before anything is sorted, and a group is
    searched bucket by bucket (counts per bucket first), so a long group is never
    sorted in one task.
    """
    from trajlake.functions.numbers import log_slot

    counts = (
        df.groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_slot", log_slot(F.col(value)))
    )
    slots = counts.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_c"))
    running = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    slots = slots.select(
        *keys,
        "_slot",
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(running).alias("_upto"),
        F.sum("_c").over(whole).alias("n"),
    )
    wanted = slots.select(
        "*",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank"))
                    for k, v in ranks.items()
                ]
            )
        ).alias("_want"),
    ).where(
        (F.col("_want.rank") >= F.col("_before")) & (F.col("_want.rank") < F.col("_upto"))
    )
    inside = (
        Window.partitionBy(*keys, "_slot", "_want.name")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        counts.join(wanted, [*keys, "_slot"])
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        .where(
            (F.col("_want.rank") < F.col("_upto"))
            & (F.col("_want.rank") >= F.col("_upto") - F.col("_c"))
        )
    )
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_want.name") == k, F.col(value))).alias(k) for k in ranks],
    )

"""One statistics table for all vector columns, and the summaries merged from it.

A pass over the frames gives the moments of every (episode, column, dim); tasks combine
their rows before anything is shuffled, so no vector moves. Episodes whose cells form no
matrix are left out afterwards, on this small table, and the rest are merged to any
coarser grouping. Counts that need the summary first (values on the extremes, values
far from the mean) take one more pass. The number of passes does not depend on the
number of columns.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.numbers import above
from trajlake.functions.vectors import all_finite, is_usable, vector
from trajlake.operators.blocks import KEYS, blocked, episode_lengths

# Datasets up to which their limits are sent to every task; beyond, frames are joined to them.
BROADCAST_DATASETS = 10_000


def _vectors(frames: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    cells = [vector(frames, c).alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = frames.select(*KEYS, *keep, *cells)
    flags = []
    for i in range(len(columns)):
        v = F.col(f"_v{i}")
        flags += [F.coalesce(is_usable(v), F.lit(False)).alias(f"_u{i}"), F.coalesce(all_finite(v), F.lit(False)).alias(f"_ok{i}")]
    return rows.select("*", *flags)


def _named(columns: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("_c")).alias("column")


def _value(number: int, **more: Column) -> Callable[[Column, Column], Column]:
    """One value of a vector as (number of its column, dim, value, more)."""
    return lambda x, d: F.struct(F.lit(number).alias("_c"), d.alias("dim"), x.alias("_x"), *[c.alias(n) for n, c in more.items()])


def _limited(number: int) -> Callable[[Column, Column], Column]:
    """The same of a value zipped with its limits."""
    return lambda z, d: _value(number, _l=z["l"])(z["v"], d)


def moments(frames: DataFrame, columns: list[str]) -> DataFrame:
    """``(keys, column, dim)`` with counts, mean, ``m2`` and range, of the episodes in which the column is a matrix.

    An episode counts for a column only when every cell is a non-empty numeric vector of one
    ``width``. A row with any NaN or infinity is left out of every dim, but its NaN and
    infinite values are counted. No columns: no rows.
    """
    if not columns:
        columns = [KEYS[0]]  # text, so no row is usable
    cells = []
    for i in range(len(columns)):
        v, ok, usable = F.col(f"_v{i}"), F.col(f"_ok{i}"), F.col(f"_u{i}")
        # Dim -1 tells whether the cell is usable, and its width.
        whole = F.struct(F.lit(i).alias("_c"), F.lit(-1).alias("dim"), F.size(v).cast("double").alias("_x"), usable.alias("_ok"))
        parts = F.transform(F.coalesce(v, F.array().cast("array<double>")), _value(i, _ok=ok))
        cells += [F.array(whole), parts]
    long = _vectors(frames, columns).select(*KEYS, F.inline(F.concat(*cells)))
    kept = F.when(F.col("_ok"), F.col("_x"))
    sums = long.groupBy(*KEYS, "_c", "dim").agg(
        F.count("*").alias("total_rows"),
        F.count(kept).alias("count"),
        F.count_if(F.isnan("_x")).alias("nan_count"),
        F.count_if(F.abs("_x") == float("inf")).alias("inf_count"),
        F.avg(kept).alias("mean"),
        (F.var_pop(kept) * F.count(kept)).alias("m2"),
        F.min(kept).alias("minimum"),
        F.max(kept).alias("maximum"),
    )
    cell = Window.partitionBy(*KEYS, "_c")  # one row per dim
    is_cell = F.col("dim") == -1
    usable = F.max(F.when(is_cell, (F.col("count") == F.col("total_rows")) & (F.col("minimum") == F.col("maximum")))).over(cell)
    width = F.max(F.when(is_cell, F.col("maximum"))).over(cell)
    rows = sums.withColumns({"_usable": usable, "width": width.cast("int")}).where(F.col("_usable") & ~is_cell)
    return rows.select(*KEYS, _named(columns), "dim", "width", *[c for c in sums.columns if c not in (*KEYS, "_c", "dim")])


def of_one_width(table: DataFrame) -> DataFrame:
    """Moments of the (dataset, column)s whose usable episodes all have one width; others have no summary."""
    per = table.groupBy("dataset", "column").agg((F.min("width") == F.max("width")).alias("_one")).where("_one")
    return table.join(per.select("dataset", "column"), ["dataset", "column"], "left_semi")


def merged(table: DataFrame, *keys: str) -> DataFrame:
    """Moments of any grouping of episodes, with ``std``. The table is read twice, so it should be a written one."""
    keys = keys or ("dataset",)
    own = [*keys, "column", "dim"]
    n = F.col("count")
    totals = table.groupBy(*own).agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("count").alias("count"),
        F.sum("nan_count").alias("nan_count"),
        F.sum("inf_count").alias("inf_count"),
        F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("mean"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
    )
    means = totals.select(*own, F.col("mean").alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    squares = table.join(means, own).groupBy(*own).agg(F.sum(F.col("m2") + n * off * off).alias("_m2"))
    # min = max decides "constant"; summed squares may leave a float residue.
    m2 = F.when(F.col("minimum") == F.col("maximum"), F.lit(0.0)).otherwise(F.col("_m2"))
    out = totals.join(squares, own).withColumn("m2", m2).drop("_m2")
    return out.withColumn("std", F.sqrt(F.try_divide(F.col("m2"), F.col("count"))))


def counts_beyond(frames: DataFrame, table: DataFrame, summary: DataFrame, columns: list[str], limit: float = 10.0) -> DataFrame:
    """``(dataset, column, dim)`` with ``at_minimum``, ``at_maximum`` and ``outliers`` over ``limit`` std from the mean.

    ``table`` are the moments, which tell the usable episodes; ``summary`` the merged ones.
    """
    number = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    one = F.struct("dim", F.col("minimum").alias("lo"), F.col("maximum").alias("hi"), F.col("mean").alias("m"), F.col("std").alias("s"))
    numbered = summary.where(F.col("column").isin(columns)).withColumn("_c", number[F.col("column")])
    limits = numbered.groupBy("dataset").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("_c") == i, one))).alias(f"_l{i}") for i in range(len(columns))]
    )
    if limits.count() <= BROADCAST_DATASETS:
        near = _vectors(frames, columns).join(F.broadcast(limits), "dataset")
    else:
        near = blocked(_vectors(frames, columns, "position"), episodes=episode_lengths(frames).join(limits, "dataset"))
    cells = []
    for i in range(len(columns)):
        zipped = F.arrays_zip(F.col(f"_v{i}").alias("v"), F.col(f"_l{i}").alias("l"))
        parts = F.transform(zipped, _limited(i))
        # A vector of another width than the summary's is in no usable episode.
        fits = F.col(f"_ok{i}") & (F.size(f"_v{i}") == F.size(f"_l{i}"))
        cells.append(F.when(fits, parts).otherwise(F.array().cast("array<struct<_c:int,dim:int,_x:double,_l:struct<dim:int,lo:double,hi:double,m:double,s:double>>>")))
    long = near.select(*KEYS, F.inline(F.concat(*cells)))
    x, at = F.col("_x"), F.col("_l")
    far = above(F.try_divide(F.abs(x - at["m"]), at["s"]), limit)
    per = long.groupBy(*KEYS, "_c", "dim").agg(
        F.count_if(x == at["lo"]).alias("at_minimum"), F.count_if(x == at["hi"]).alias("at_maximum"), F.count_if(far).alias("outliers")
    )
    usable = table.select(*KEYS, "column").distinct()
    kept = per.select(*KEYS, _named(columns), "dim", "at_minimum", "at_maximum", "outliers").join(usable, [*KEYS, "column"], "left_semi")
    names = ("at_minimum", "at_maximum", "outliers")
    return kept.groupBy("dataset", "column", "dim").agg(*[F.sum(c).alias(c) for c in names])

"""Named series: features flattened to one value per name and frame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions.vectors import depth, field_type, quoted, vector
from trajlake.operators.blocks import KEYS

# Fixed names.
DELIMITER = " | "
CHARTABLE = (
    "float16", "float32", "float64", "int8", "int16", "int32", "int64",
    "uint8", "uint16", "uint32", "uint64", "bool", "boolean",
)
EXCLUDED_V3 = (
    "index", "task_index", "episode_index", "frame_index", "next.reward", "next.done", "next.truncated", "subtask_index",
)
EXCLUDED_V2 = (
    "timestamp", "frame_index", "episode_index", "index", "task_index", "next.reward", "next.done", "next.truncated",
)


def chartable(features: DataFrame, v3: bool = True) -> DataFrame:
    """Numeric one-dimensional features that are not bookkeeping."""
    names = EXCLUDED_V3 if v3 else EXCLUDED_V2
    return features.where(
        F.lower("dtype").isin(*CHARTABLE) & (F.size("shape") == 1) & ~F.col("feature").isin(*names)
    )


def ignored(features: DataFrame, v3: bool = True) -> DataFrame:
    """Features left out of charts: of too high a rank, or bookkeeping."""
    names = EXCLUDED_V3 if v3 else EXCLUDED_V2
    high = F.lower("dtype").isin(*CHARTABLE) & (F.size("shape") > (2 if v3 else 1))
    return features.where(high | F.col("feature").isin(*names)).select("dataset", "feature")


def number(df: DataFrame, column: str) -> Column:
    """A scalar or boolean cell as a number (true is 1)."""
    return quoted(column).cast("double")


def flatten(frames: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Long form ``(keys, position, source, name, value)`` of the columns.

    ``names`` is ``(dataset, feature, dim, name)``; values beyond the named
    dims are left out. Scalars keep the column as their name.
    """
    cells = []
    for c in columns:
        dtype = field_type(frames, c)
        is_list = depth(dtype) > 0
        value = vector(frames, c) if is_list else F.array(number(frames, c))
        cells.append(
            F.struct(F.lit(c).alias("source"), F.lit(is_list).alias("listed"), value.cast(T.ArrayType(T.DoubleType())).alias("v"))
        )
    long = (
        frames.select(*KEYS, "position", F.explode(F.array(*cells)).alias("_c"))
        .select(*KEYS, "position", "_c.source", "_c.listed", F.posexplode("_c.v").alias("dim", "value"))
    )
    labels = names.select("dataset", F.col("feature").alias("source"), "dim", "name")
    named = long.join(labels, ["dataset", "source", "dim"], "left")
    named = named.where(~F.col("listed") | F.col("name").isNotNull())
    return named.where(F.col("value").isNotNull()).select(
        *KEYS, "position", "source", F.when(F.col("listed"), F.col("name")).alias("name"), "value"
    )


def series_key() -> Column:
    return F.concat_ws(DELIMITER, "source", "name")


def suffix(key: Column) -> Column:
    """The part of a series key after the delimiter, or the whole key."""
    parts = F.split(key, r" \| ")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(key)


def short_name(key: Column) -> Column:
    return F.element_at(F.split(key, r" \| "), -1)


def group_by_suffix(series: DataFrame) -> DataFrame:
    """Series of a frame that share a name across sources become one entry.

    ``values`` maps source to value; a name with a single source keeps its full
    key and its value alone.
    """
    per = series.groupBy(*KEYS, "position", F.coalesce("name", "source").alias("suffix")).agg(
        # One entry per source column.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "value")))).alias("values"),
        F.min(series_key()).alias("_key"),
    )
    many = F.size("values") > 1
    return per.select(
        *KEYS,
        "position",
        F.when(many, F.col("suffix")).otherwise(F.col("_key")).alias("key"),
        "values",
        many.alias("grouped"),
    )

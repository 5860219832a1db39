"""The catalogue of datasets: grouping, totals, ranking, day snapshots, tags."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.numbers import round_half_up
from trajlake.operators.blocks import positions

# Fixed values.
UNGROUPED = "Ungrouped"
FLAT_HOURS = 0.005
DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
COUNTS = ("tasks", "episodes", "frames")


def prefix(path: Column) -> Column:
    """First path segment; paths without one share a bucket."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(UNGROUPED))


def task_name(path: Column) -> Column:
    at = F.instr(path, "/")
    return F.when(at > 0, F.substr(path, at + 1)).otherwise(path)


def hours(frames: Column, fps: Column) -> Column:
    return F.when((fps > 0) & (frames > 0), frames / fps / 3600.0).otherwise(F.lit(0.0))


def health(total_episodes: Column, has_data: Column, has_videos: Column) -> Column:
    return (
        F.when(F.coalesce(total_episodes, F.lit(0)) <= 0, "empty")
        .when(~has_data | ~has_videos, "incomplete")
        .otherwise("ok")
    )


def group_by_prefix(catalog: DataFrame) -> DataFrame:
    status = F.col("status")
    return catalog.groupBy(prefix(F.col("path")).alias("prefix")).agg(
        F.count("*").alias("tasks"),
        F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "empty").alias("empty"),
        F.count_if((status != "ok") & (status != "empty")).alias("incomplete"),
        F.sum(F.coalesce("total_episodes", F.lit(0))).alias("episodes"),
        F.sum(F.coalesce("total_frames", F.lit(0))).alias("frames"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )


def corpus_stats(catalog: DataFrame) -> DataFrame:
    """Totals per prefix with hours, share of all hours and mean episode seconds."""
    per = catalog.groupBy(prefix(F.col("path")).alias("prefix")).agg(
        F.count("*").alias("tasks"),
        F.sum(hours(F.col("total_frames"), F.col("fps"))).alias("hours"),
        F.sum(F.coalesce("total_episodes", F.lit(0))).alias("episodes"),
        F.sum(F.coalesce("total_frames", F.lit(0))).alias("frames"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )
    total = per.agg(F.sum("hours")).scalar()
    return per.withColumn(
        "share", F.when(total > 0, F.col("hours") / total).otherwise(F.lit(0.0))
    ).withColumn(
        "episode_seconds", F.when(F.col("episodes") > 0, F.col("hours") * 3600 / F.col("episodes"))
    )


def corpus_totals(segments: DataFrame) -> DataFrame:
    """The per-prefix rows and, with a null prefix, the grand total."""
    return segments.rollup("prefix").agg(
        *[F.sum(c).alias(c) for c in ("tasks", "hours", "episodes", "frames", "bytes")]
    )


def rank_datasets(catalog: DataFrame) -> DataFrame:
    """Datasets of each prefix, biggest first: bytes, frames, episodes, then path."""
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    rows = catalog.withColumn("prefix", prefix(F.col("path"))).withColumn("_size", size)
    order = [
        F.desc("_size"),
        F.desc(F.coalesce("total_frames", F.lit(0))),
        F.desc(F.coalesce("total_episodes", F.lit(0))),
        F.asc("path"),
    ]
    return positions(rows, order, -F.col("_size"), ["prefix"], "rank").drop("_size")


def rank_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("bytes"), F.desc("frames"), F.desc("episodes"), F.asc("prefix"))


def rank_segments(segments: DataFrame) -> DataFrame:
    return segments.orderBy(F.desc("hours"), F.asc("prefix"))


def health_counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(~F.col("status").isin("ok", "empty")).alias("incomplete"),
        F.count_if(F.col("status") != "ok").alias("issues"),
    )


def tag_counts(catalog: DataFrame) -> DataFrame:
    """Datasets per task tag; the null tag counts the untagged."""
    tag = F.when(F.col("task") != "", F.col("task"))
    return catalog.groupBy(tag.alias("task")).agg(F.count("*").alias("datasets"))


def robots(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("robot_type") != "").select("robot_type").distinct()


def select_datasets(
    catalog: DataFrame,
    text: str = "",
    robot: str | None = None,
    status: str | None = None,
    task: str | None = None,
    untagged: bool = False,
) -> DataFrame:
    """Filter by robot, health (``ok``/``issues``), task tag, and text in any field."""
    out = catalog
    if robot is not None:
        out = out.where(F.col("robot_type") == robot)
    if status is not None:
        good = F.col("status") == "ok"
        out = out.where(good if status == "ok" else ~good)
    no_task = F.coalesce(F.col("task"), F.lit("")) == ""
    if untagged:
        out = out.where(no_task)
    elif task is not None:
        out = out.where(F.col("task") == task)
    needle = text.strip().lower()
    if needle:
        fields = [F.coalesce(F.lower(c), F.lit("")).contains(needle) for c in ("path", "robot_type", "task", "scene")]
        hit = fields[0] | fields[1] | fields[2] | fields[3]
        hit = hit | F.coalesce(F.exists("objects", lambda o: F.lower(o).contains(needle)), F.lit(False))
        out = out.where(hit)
    return out


def select_groups(catalog: DataFrame, text: str) -> DataFrame:
    """Prefixes that contain the text, or have a dataset whose path does."""
    needle = text.strip().lower()
    name = prefix(F.col("path"))
    hit = F.lower(name).contains(needle) | F.lower("path").contains(needle)
    return catalog.where(hit).select(name.alias("prefix")).distinct()


def with_tag_overrides(catalog: DataFrame, overrides: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Replace stored tags by newer ones per path, and leave out removed paths."""
    fields = [c for c in overrides.columns if c != "path"]
    new = overrides.select("path", F.struct(*fields).alias("_new"))
    out = catalog.join(new, "path", "left")
    out = out.withColumns(
        {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields}
    ).drop("_new")
    return out if removed is None else out.join(removed.select("path"), "path", "left_anti")


def snapshot(segments: DataFrame, day: Column) -> DataFrame:
    """One day's rows for the history: hours kept at 3 digits."""
    return segments.select(
        day.alias("day"),
        F.col("prefix").alias("source"),
        *COUNTS,
        round_half_up(F.col("hours"), 3).alias("hours"),
        "bytes",
    )


def record_day(history: DataFrame, today: DataFrame, keep_days: int | None = None) -> DataFrame:
    """Put today's rows in place of the same day's and drop malformed days.

    With ``keep_days``, only so many of the latest days stay.
    """
    day_of_today = today.select("day").distinct()
    rest = history.where(F.col("day").rlike(DAY_PATTERN) & F.col("source").isNotNull())
    merged = rest.join(day_of_today, "day", "left_anti").unionByName(today)
    if keep_days is None:
        return merged
    # One row per calendar day, so this window is small whatever the history holds.
    days = merged.select("day").distinct()
    kept = days.withColumn("_age", F.row_number().over(Window.orderBy(F.desc("day")))).where(
        F.col("_age") <= max(1, keep_days)
    )
    return merged.join(kept.select("day"), "day", "left_semi")


def previous_days(history: DataFrame) -> DataFrame:
    """Each recorded day with the latest recorded day before it and the days between."""
    days = history.where(F.col("day").rlike(DAY_PATTERN)).select("day").distinct()
    before = F.lag("day").over(Window.orderBy("day"))  # one row per calendar day
    out = days.select("day", before.alias("since"))
    return out.withColumn("span_days", F.datediff(F.to_date("day"), F.to_date("since")))


def daily_growth(history: DataFrame) -> DataFrame:
    """Change per (day, source) since the day recorded before it.

    A source new on the day counts in full, a vanished one negatively. Bytes are
    null where the earlier size was never measured.
    """
    links = previous_days(history).where(F.col("since").isNotNull())
    value = F.struct(*COUNTS, "hours", "bytes")
    now = history.join(links, "day").select("day", "since", "span_days", "source", value.alias("_now"))
    old = history.select(F.col("day").alias("since"), "source", value.alias("_old")).join(links, "since")
    old = old.select("day", "since", "span_days", "source", "_old")
    both = now.join(old, ["day", "since", "span_days", "source"], "full")
    zero = F.lit(0)

    def change(c):
        return F.coalesce(F.col(f"_now.{c}"), zero) - F.coalesce(F.col(f"_old.{c}"), zero)

    size = F.when(F.col("_old").isNull(), F.col("_now.bytes")).otherwise(
        F.coalesce(F.col("_now.bytes"), zero) - F.col("_old.bytes")
    )
    return both.select(
        "day", "since", "span_days", "source", *[change(c).alias(c) for c in (*COUNTS, "hours")], size.alias("bytes")
    )


def growth_totals(growth: DataFrame) -> DataFrame:
    """Totals per day; one unknown size makes the day's bytes unknown."""
    return growth.groupBy("day", "since", "span_days").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "hours")],
        F.when(F.count_if(F.col("bytes").isNull()) == 0, F.sum("bytes")).alias("bytes"),
    )


def is_flat() -> Column:
    """No measurable change: unknown bytes do not count as one."""
    same = [F.col(c) == 0 for c in COUNTS]
    return (
        same[0] & same[1] & same[2]
        & (F.abs("hours") < FLAT_HOURS)
        & (F.col("bytes").isNull() | (F.col("bytes") == 0))
    )


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def manifest_state(manifest: DataFrame, inventory: DataFrame, datasets: DataFrame) -> DataFrame:
    """A dataset is current when every listed file is there at its listed size.

    No manifest rows means stale.
    """
    files = inventory.select("dataset", "path", F.col("size").alias("_size"))
    good = F.col("_size").isNotNull() & (F.col("size").isNull() | (F.col("size") == F.col("_size")))
    per = (
        manifest.join(files, ["dataset", "path"], "left")
        .groupBy("dataset")
        .agg(F.bool_and(good).alias("_current"), F.count("*").alias("listed"))
    )
    return datasets.select("dataset").distinct().join(per, "dataset", "left").select(
        "dataset",
        F.coalesce("listed", F.lit(0)).alias("listed"),
        F.coalesce("_current", F.lit(False)).alias("current"),
    )


def inventory_totals(inventory: DataFrame, large: int = 5 * 1024**3) -> DataFrame:
    """Bytes and counts of troublesome files per dataset."""
    path = F.col("path")
    return inventory.groupBy("dataset").agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if("symlink").alias("symlinks"),
        F.count_if(~F.col("readable")).alias("unreadable"),
        F.count_if(path.startswith("data/") & ~path.endswith(".parquet")).alias("not_parquet"),
        F.count_if(F.col("size") > large).alias("large_files"),
    )


def flag(flagged: DataFrame, more: DataFrame) -> DataFrame:
    """Add episodes to the flagged set."""
    keys = ["dataset", "episode_index"]
    return flagged.select(*keys).union(more.select(*keys)).distinct()

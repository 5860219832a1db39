"""Subtask segments: clean-up, edits, vocabulary, and a label on every frame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import number_or_null
from trajlake.operators.blocks import KEYS, as_of, positions, shifted

# Frames per stretch when segments and frames are matched in frame order.
STRETCH = 65536.0


def whole(c: Column) -> Column:
    """A whole number from lenient input, cut toward zero; null when it is not a number."""
    n = number_or_null(c)
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")


def coerce(segments: DataFrame) -> DataFrame:
    """Keep segments with text; start >= 0, end >= start, success null or >= 0."""
    start = F.greatest(F.lit(0), F.coalesce(whole(F.col("start_frame_index")), F.lit(0)))
    success = whole(F.col("success_frame_index"))
    return (
        segments.withColumn("instruction", F.trim("instruction"))
        .where(F.col("instruction") != "")
        .withColumns(
            {
                "skill": F.trim(F.coalesce("skill", F.lit(""))),
                "start_frame_index": start,
                "success_frame_index": F.when(
                    F.col("success_frame_index").isNotNull(),
                    F.greatest(F.lit(0), F.coalesce(success, F.lit(0))),
                ),
            }
        )
        .withColumn(
            "end_frame_index",
            F.greatest("start_frame_index", F.coalesce(whole(F.col("end_frame_index")), F.lit(0))),
        )
    )


def normalise(segments: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Make an episode's segments contiguous from frame 0 to its ``last_frame``.

    Of segments that start on one frame the last entry wins (by raw start,
    then ``entry``). Each ends where the next starts; a success frame outside
    its segment is dropped; ids are renumbered in order.
    """
    cap = F.greatest(F.lit(0), F.col("last_frame"))
    placed = segments.join(last_frames.select(*KEYS, "last_frame"), KEYS).withColumn(
        "_start", F.least(cap, F.greatest(F.lit(0), F.col("start_frame_index"))).cast("long")
    )
    rest = [c for c in segments.columns if c not in KEYS]
    one = placed.groupBy(*KEYS, "_start").agg(
        F.max_by(F.struct(*rest, "last_frame"), F.struct("start_frame_index", "entry")).alias("_s")
    )
    numbered = positions(one, ["_start"], F.col("_start"), KEYS, "_id")
    numbered = numbered.withColumn("_stretch", F.floor(F.col("_start") / STRETCH))
    chained = shifted(numbered, F.col("_start"), ["_start"], "_stretch", KEYS, "_next", ahead=True)
    start = F.when(F.col("_id") == 0, F.lit(0).cast("long")).otherwise(F.col("_start"))
    limit = F.greatest(F.lit(0), F.col("_s.last_frame"))
    end = F.greatest(start, F.coalesce("_next", limit)).cast("long")
    success = F.col("_s.success_frame_index")
    kept = [c for c in rest if c not in ("segment_id", "start_frame_index", "end_frame_index", "success_frame_index")]
    return chained.select(
        *KEYS,
        F.col("_id").alias("segment_id"),
        start.alias("start_frame_index"),
        end.alias("end_frame_index"),
        F.when((success >= start) & (success <= end), success).alias("success_frame_index"),
        *[F.col(f"_s.{c}").alias(c) for c in kept],
    )


def insert(segments: DataFrame, new: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Start new segments at given frames; one already starting there is replaced."""
    cap = F.greatest(F.lit(0), F.col("last_frame"))
    fresh = (
        new.withColumn("instruction", F.trim("instruction"))
        .where(F.col("instruction") != "")
        .join(last_frames.select(*KEYS, "last_frame"), KEYS)
        .withColumn("start_frame_index", F.least(cap, F.greatest(F.lit(0), F.col("start_frame_index"))).cast("long"))
        .drop("last_frame")
    )
    others = segments.join(fresh.select(*KEYS, "start_frame_index"), [*KEYS, "start_frame_index"], "left_anti")
    both = others.unionByName(
        fresh.withColumn("entry", F.lit(2**62)), allowMissingColumns=True
    )
    return normalise(both, last_frames)


def remove(segments: DataFrame, ids: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Delete segments by id; the gaps close."""
    return normalise(segments.join(ids.select(*KEYS, "segment_id"), [*KEYS, "segment_id"], "left_anti"), last_frames)


def update_text(segments: DataFrame, changes: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Replace text fields of segments by id; a null change keeps the old text."""
    fields = [c for c in changes.columns if c not in (*KEYS, "segment_id")]
    new = changes.select(*KEYS, "segment_id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = segments.join(new, [*KEYS, "segment_id"], "left")
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])
    return normalise(out, last_frames)


def retime(segments: DataFrame, moves: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Move segment starts, each kept strictly between its neighbours; the first stays.

    ``moves`` holds at most one ``(keys, segment_id, new_start)`` per episode.
    """
    norm = normalise(segments, last_frames)
    ids = norm.withColumn("_stretch", F.floor(F.col("segment_id") / STRETCH))
    near = shifted(ids, F.col("start_frame_index"), ["segment_id"], "_stretch", KEYS, "_prev")
    near = shifted(near, F.col("start_frame_index"), ["segment_id"], "_stretch", KEYS, "_next", ahead=True)
    moved = near.join(moves, [*KEYS, "segment_id"], "left").join(
        last_frames.select(*KEYS, "last_frame"), KEYS
    )
    low = F.col("_prev") + 1
    high = F.coalesce(F.col("_next") - 1, F.greatest(F.lit(0), F.col("last_frame")))
    target = F.least(F.greatest(F.col("new_start"), low), F.greatest(low, high))
    start = F.when(
        F.col("new_start").isNotNull() & (F.col("segment_id") > 0), target
    ).otherwise(F.col("start_frame_index"))
    out = moved.withColumn("start_frame_index", start.cast("long")).withColumn("entry", F.col("segment_id"))
    return normalise(out.drop("_stretch", "_prev", "_next", "new_start", "last_frame"), last_frames)


def vocabulary(existing: DataFrame, tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """``(dataset, text, subtask_index)``: old entries keep their number, new ones are appended.

    New texts come from the task table by index, then from the segments by
    episode and start, each at its first appearance.
    """
    zero = F.lit(0).cast("long")
    texts = tasks.select(
        "dataset",
        F.col("task").alias("text"),
        F.struct(
            F.lit(0).alias("a"), F.col("task_index").cast("long").alias("b"), zero.alias("c"), zero.alias("d")
        ).alias("_at"),
    ).unionByName(
        segments.select(
            "dataset",
            F.col("instruction").alias("text"),
            F.struct(
                F.lit(1).alias("a"),
                F.col("episode_index").cast("long").alias("b"),
                F.col("start_frame_index").cast("long").alias("c"),
                F.col("entry").cast("long").alias("d"),
            ).alias("_at"),
        )
    )
    first = texts.groupBy("dataset", "text").agg(F.min("_at").alias("_at"))
    new = first.join(existing.select("dataset", "text"), ["dataset", "text"], "left_anti")
    # All task texts come before all segment texts, so this never decreases.
    along = F.when(F.col("_at.a") == 0, F.lit(-1)).otherwise(F.col("_at.b"))
    new = positions(new, ["_at"], along, ["dataset"], "_place")
    sizes = existing.groupBy("dataset").agg(F.count("*").alias("_size"))
    added = new.join(sizes, "dataset", "left").select(
        "dataset", "text", (F.coalesce("_size", zero) + F.col("_place")).alias("subtask_index")
    )
    return existing.select("dataset", "text", F.col("subtask_index").cast("long")).unionByName(added)


def label_frames(
    frames: DataFrame, segments: DataFrame, tasks: DataFrame, vocab: DataFrame
) -> DataFrame:
    """Add ``subtask_index`` to every frame.

    The active segment's text; before the first segment, the first one's; in an
    episode without segments, the frame's task text; 0 where that is unknown.
    """
    codes = vocab.select("dataset", F.col("text").alias("_text"), F.col("subtask_index").alias("_code"))
    marks = (
        segments.withColumn("_text", F.trim("instruction"))
        .where(F.col("_text") != "")
        .join(codes, ["dataset", "_text"])
        .select(*KEYS, F.col("start_frame_index").cast("long").alias("frame_index"), "_code", F.col("entry").alias("_entry"))
    )
    # The first segment also covers the frames before it.
    head = marks.groupBy(*KEYS).agg(
        F.min_by("_code", F.struct("frame_index", "_entry")).alias("_code"),
        F.min("frame_index").alias("_first"),
    )
    head = head.where(F.col("_first") > 0).select(
        *KEYS, F.lit(0).cast("long").alias("frame_index"), "_code", F.lit(-1).cast("long").alias("_entry")
    )
    fallback = (
        tasks.select("dataset", "task_index", F.col("task").alias("_text"))
        .join(codes, ["dataset", "_text"])
        .select("dataset", "task_index", F.col("_code").alias("_task_code"))
    )
    rows = frames.drop("subtask_index")
    out = as_of(rows, marks.unionByName(head), "frame_index", "_code", STRETCH, tie=["_entry"])
    out = out.join(fallback, ["dataset", "task_index"], "left")
    index = F.coalesce("_code", "_task_code", F.lit(0).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], index.alias("subtask_index"))

"""Language atoms on frames: embedding, precedence, spans, as-of and band joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.language import PERSISTENT_STYLES, SPAN_STYLES, is_speech, vqa_kind
from trajlake.functions.vectors import quoted
from trajlake.operators.blocks import KEYS, as_of, shifted

ATOM_FIELDS = ["role", "content", "style", "timestamp", "camera", "tool_calls"]
# Seconds per stretch when atoms and frames are matched in time order.
STRETCH = 3600.0


def coerce(atoms: DataFrame) -> DataFrame:
    """Drop atoms without a role; an empty camera means none; a missing time is 0."""
    return atoms.where(F.col("role").isNotNull() & (F.col("role") != "")).withColumns(
        {
            "camera": F.when(F.col("camera") != "", F.col("camera")),
            "timestamp": F.coalesce("timestamp", F.lit(0.0)),
        }
    )


def embedded_atoms(frames: DataFrame) -> DataFrame:
    """Atoms stored in frame columns.

    The persistent list is repeated on every row: it is taken once, from the
    first row that has one, without repeats. Events are taken from every row,
    with the row's time where they have none.
    """
    has = F.size("language_persistent") > 0
    first = (
        frames.where(has)
        .groupBy(*KEYS)
        .agg(F.min_by("language_persistent", "position").alias("_list"))
        .select(*KEYS, F.explode("_list").alias("_a"))
        .select(*KEYS, "_a.*")
    )
    persistent = distinct_atoms(coerce(first)).withColumn("source", F.lit("language_persistent"))
    events = frames.select(*KEYS, F.col("timestamp").alias("_ts"), F.explode("language_events").alias("_a"))
    events = events.select(*KEYS, "_ts", "_a.*").withColumn(
        "timestamp", F.coalesce("timestamp", "_ts")
    )
    events = coerce(events.drop("_ts")).withColumn("source", F.lit("language_events"))
    return persistent.unionByName(events)


def distinct_atoms(atoms: DataFrame) -> DataFrame:
    """One atom per style, role, time, camera and content of an episode."""
    return atoms.dropDuplicates([*KEYS, "style", "role", "timestamp", "camera", "content"])


def partition_atoms(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persistent atoms and events, each in time order within the episode."""
    lasting = F.coalesce(F.col("style").isin(*PERSISTENT_STYLES), F.lit(False))
    order = [*KEYS, "timestamp"]
    return atoms.where(lasting).orderBy(*order), atoms.where(~lasting).orderBy(*order)


def by_precedence(*layers: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per episode, the rows of the first layer that has any: an empty layer counts as none."""
    out = None
    for layer in layers:
        if out is None:
            out = layer
        else:
            taken = out.select(*keys).distinct()
            out = out.unionByName(layer.join(taken, keys, "left_anti"), allowMissingColumns=True)
    return out


def spans(atoms: DataFrame, durations: DataFrame) -> DataFrame:
    """Time spans of atoms: subtasks and plans last until the next one of their style.

    Task rephrasings cover the whole episode; all other shown atoms are ticks
    with an equal start and end. ``order`` keeps atoms of one time apart.
    """
    timed = atoms.join(durations.select(*KEYS, "duration"), KEYS).withColumn(
        "_stretch", F.floor(F.col("timestamp") / STRETCH)
    )
    lasting = shifted(
        timed.where(F.col("style").isin(*SPAN_STYLES)),
        F.col("timestamp"),
        ["timestamp", "order"],
        "_stretch",
        [*KEYS, "style"],
        "_next",
        ahead=True,
    )
    whole = F.col("style") == "task_aug"
    speech = is_speech(F.col("style"), F.col("role"), F.col("tool_calls"))
    answer = (F.col("style") == "vqa") & (F.col("role") == "assistant")
    ticks = timed.where(F.col("style").isin("memory", "interjection") | speech | answer)
    base = [*KEYS, "order"]
    lane = F.coalesce("style", F.lit("interjection"))
    content = F.when(F.col("content") != "", F.col("content"))
    return (
        lasting.select(
            *base,
            F.col("style").alias("lane"),
            F.lit("span").alias("kind"),
            F.col("timestamp").alias("start"),
            F.coalesce("_next", "duration").alias("end"),
            F.coalesce(content, F.when(F.col("style") == "plan", "plan").otherwise("")).alias("label"),
        )
        .unionByName(
            timed.where(whole).select(
                *base,
                F.col("style").alias("lane"),
                F.lit("span").alias("kind"),
                F.lit(0.0).alias("start"),
                F.col("duration").alias("end"),
                F.coalesce(content, F.col("style")).alias("label"),
            )
        )
        .unionByName(
            ticks.select(
                *base,
                lane.alias("lane"),
                F.lit("tick").alias("kind"),
                F.col("timestamp").alias("start"),
                F.col("timestamp").alias("end"),
                F.when(F.col("style") == "memory", F.coalesce(content, F.lit("memory")))
                .when(F.col("style") == "interjection", F.coalesce(content, F.lit("")))
                .when(F.col("style") == "vqa", F.coalesce(vqa_kind(F.col("content")), F.lit("vqa")))
                .otherwise(F.lit("speech"))
                .alias("label"),
            )
        )
    )


def active_atoms(frames: DataFrame, atoms: DataFrame, style: str, width: float = STRETCH) -> DataFrame:
    """For each frame, the content of the style's last atom at or before its time."""
    marks = atoms.where(F.col("style") == style).select(
        *KEYS, "timestamp", F.col("content").alias("active"), "order"
    )
    return as_of(frames, marks, "timestamp", "active", width, tie=["order"])


def events_near(
    probes: DataFrame, events: DataFrame, window: float = 1 / 60, strict: bool = False
) -> DataFrame:
    """Pairs of a probe time ``at`` and an event at most ``window`` seconds away.

    ``strict`` keeps the distance below the window. Each probe looks into its
    own and the two neighbouring buckets of window width.
    """
    slot = F.floor(F.col("at") / window)
    near = probes.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    placed = events.withColumn("_slot", F.floor(F.col("timestamp") / window))
    gap = F.abs(F.col("timestamp") - F.col("at"))
    return (
        near.join(placed, [*KEYS, "_slot"])
        .where((gap < window) if strict else (gap <= window))
        .drop("_slot")
    )


def snap_to_frames(points: DataFrame, frames: DataFrame, width: float = STRETCH) -> DataFrame:
    """Move each point's ``timestamp`` to the nearest frame; a tie goes to the earlier frame.

    Adds ``frame_time`` and ``frame_position`` (of equal times, the first).
    """
    marks = frames.select(
        *KEYS,
        "timestamp",
        F.struct(F.col("timestamp").alias("t"), F.col("position").alias("p")).alias("_mark"),
        (-F.col("position")).alias("_tie"),
    )
    before = as_of(points, marks, "timestamp", "_mark", width, tie=["_tie"]).withColumnRenamed(
        "_mark", "_before"
    )
    # The frame after is the last one at or before in reversed time.
    reverse = marks.withColumn("timestamp", -F.col("timestamp"))
    turned = before.withColumn("timestamp", -F.col("timestamp"))
    both = as_of(turned, reverse, "timestamp", "_mark", width, tie=["_tie"])
    t = -F.col("timestamp")
    both = both.withColumn("timestamp", t)
    gap_before = F.col("timestamp") - F.col("_before.t")
    gap_after = F.col("_mark.t") - F.col("timestamp")
    earlier = F.col("_mark").isNull() | (F.col("_before").isNotNull() & (gap_before <= gap_after))
    nearest = F.when(earlier, F.col("_before")).otherwise(F.col("_mark"))
    return both.withColumn("_near", nearest).select(
        *[c for c in points.columns],
        F.coalesce("_near.t", "timestamp").alias("frame_time"),
        F.col("_near.p").alias("frame_position"),
    )


def time_to_frame(t: Column, fps: Column) -> Column:
    rate = F.when(fps.isNull() | (fps == 0), 1.0).otherwise(fps)
    return F.greatest(F.lit(0), F.floor(t * rate + 0.5)).cast("long")


def frame_to_time(frame: Column, fps: Column) -> Column:
    return frame / F.when(fps.isNull() | (fps == 0), 1.0).otherwise(fps)


def instruction_columns(frames: DataFrame) -> list[str]:
    """language_instruction, then its numbered followers as far as they go without a gap."""
    names = []
    if "language_instruction" in frames.columns:
        names.append("language_instruction")
    number = 2
    while f"language_instruction_{number}" in frames.columns:
        names.append(f"language_instruction_{number}")
        number += 1
    return names


def row_instruction(frames: DataFrame) -> Column:
    """All instructions of a row joined by newlines; null when it has none.

    A numbered one counts only while all numbered ones before it are set.
    """
    names = instruction_columns(frames)
    if not names:
        return F.lit(None).cast("string")
    parts, unbroken = [], F.lit(True)
    for name in names:
        cell = quoted(name)
        if name == "language_instruction":
            parts.append(cell)
            continue
        unbroken = unbroken & cell.isNotNull()
        parts.append(F.when(unbroken, cell))
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def episode_task(frames: DataFrame, episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each episode's task text, by precedence.

    First the episode's own ``tasks`` list; then the instructions on its first,
    middle or last frame, whichever has one; then the task table, by the first
    frame's ``task_index`` value.
    """
    text = row_instruction(frames)
    lengths = frames.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min_by("task_index", "position").alias("task_index")
    )
    # Frames at the three places only; the place list is short and per episode.
    places = lengths.select(
        *KEYS,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("position")),
                F.struct(F.lit(1).alias("rank"), F.floor(F.col("n") / 2).alias("position")),
                F.struct(F.lit(2).alias("rank"), (F.col("n") - 1).alias("position")),
            )
        ).alias("_p"),
    ).select(*KEYS, "_p.rank", "_p.position")
    said = (
        frames.select(*KEYS, "position", text.alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(places, [*KEYS, "position"])
        .groupBy(*KEYS)
        .agg(F.min_by("_text", "rank").alias("_said"))
    )
    own = F.array_join("tasks", "\n")
    listed = F.when(F.size("tasks") > 0, F.when(own != "", own))
    return (
        lengths.join(episodes.select(*KEYS, listed.alias("_own")), KEYS, "left")
        .join(said, KEYS, "left")
        .join(
            tasks.where(F.col("task_index") >= 0).select("dataset", "task_index", F.col("task").alias("_listed")),
            ["dataset", "task_index"],
            "left",
        )
        .select(
            *KEYS,
            F.coalesce("_own", F.when(F.col("_said") != "", F.col("_said")), "_listed").alias("task"),
        )
    )


def with_task_text(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each frame's task text by ``task_index`` value."""
    return frames.join(tasks.select("dataset", "task_index", "task"), ["dataset", "task_index"], "left")

"""Annotation, segment and tag files kept next to a dataset, and their updates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.language import ATOM_SCHEMA
from trajlake.functions.tags import clean_notes, clean_objects, clean_tag
from trajlake.operators.annotations import coerce as coerce_atoms
from trajlake.operators.blocks import KEYS

ATOM_DOCUMENT = (
    "episodes map<string, struct<atoms: array<struct<"
    + ", ".join(f.strip().replace(" ", ": ") for f in ATOM_SCHEMA.split(","))
    + ">>>>"
)
SEGMENT_RECORD = (
    "episode_index double, high_level_instruction string, instruction_segments array<struct<"
    "segment_id: string, skill: string, instruction: string, paraphrases: array<string>, "
    "start_frame_index: string, success_frame_index: string, end_frame_index: string>>"
)
TAG_DOCUMENT = "task string, scene string, objects array<string>, notes string, updated_at string"


def parse_atoms(documents: DataFrame) -> DataFrame:
    """Atoms of ``(dataset, text)`` documents; entries without a role are dropped."""
    entries = documents.select(
        "dataset", F.explode(F.from_json("text", ATOM_DOCUMENT)["episodes"]).alias("_id", "_e")
    )
    atoms = entries.select(
        "dataset", F.col("_id").try_cast("long").alias("episode_index"), F.posexplode("_e.atoms").alias("order", "_a")
    ).where(F.col("episode_index").isNotNull())
    return coerce_atoms(atoms.select(*KEYS, "order", "_a.*"))


def parse_segments(documents: DataFrame) -> DataFrame:
    """Segments of ``(dataset, text)`` documents: line JSON, an array, or one object.

    Of several records for an episode the last one wins.
    """
    body = F.trim("text")
    lines = F.filter(F.transform(F.split("text", "\r?\n"), F.trim), lambda x: x != "")
    by_line = F.forall(lines, lambda x: x.startswith("{") & x.endswith("}"))
    listed = F.when(
        body.startswith("["), F.from_json(body, f"array<struct<{_as_struct(SEGMENT_RECORD)}>>")
    ).otherwise(
        F.transform(
            F.when(by_line, lines).otherwise(F.array(body)),
            lambda x: F.from_json(x, SEGMENT_RECORD),
        )
    )
    records = documents.select("dataset", F.posexplode(listed).alias("_at", "_r")).where(
        F.col("_r.episode_index").isNotNull()
    )
    latest = records.groupBy("dataset", F.col("_r.episode_index").cast("long").alias("episode_index")).agg(
        F.max_by("_r", "_at").alias("_r")
    )
    return latest.select(
        *KEYS,
        F.col("_r.high_level_instruction").alias("high_level_instruction"),
        F.posexplode("_r.instruction_segments").alias("entry", "_s"),
    ).select(*KEYS, "high_level_instruction", F.col("entry").cast("long").alias("entry"), "_s.*")


def _as_struct(fields: str) -> str:
    """``name type`` fields as ``name: type``, outermost level only."""
    out, depth = [], 0
    for part in fields.split(","):
        if depth == 0:
            part = part.strip().replace(" ", ": ", 1)
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


def upsert(existing: DataFrame, records: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Replace the records of the given keys; keep all others and unknown columns."""
    rest = existing.join(records.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(records, allowMissingColumns=True)


def parse_tags(documents: DataFrame) -> DataFrame:
    """Cleaned tags of ``(dataset, text)`` documents; unreadable ones are empty."""
    t = F.from_json("text", TAG_DOCUMENT)
    return clean_tags(documents.select("dataset", t.alias("_t")).select("dataset", "_t.*"))


def clean_tags(tags: DataFrame) -> DataFrame:
    return tags.withColumns(
        {
            "task": clean_tag(F.col("task")),
            "scene": clean_tag(F.col("scene")),
            "objects": clean_objects(F.col("objects")),
            "notes": clean_notes(F.col("notes")),
        }
    )


def tags_for(datasets: DataFrame, tags: DataFrame) -> DataFrame:
    """Every dataset with its tags; one without a file has empty tags."""
    empty = F.array().cast("array<string>")
    return datasets.select("dataset").distinct().join(tags, "dataset", "left").withColumn(
        "objects", F.coalesce("objects", empty)
    )


def update_tags(tags: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Store cleaned changes with their time in place of the datasets' old tags."""
    return upsert(tags, clean_tags(changes).withColumn("updated_at", now), ["dataset"])

"""Clean-up of user tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_tag(value: Column, most: int | None = None) -> Column:
    """Trimmed, lower case, white space as ``_``; empty is null. With ``most``, cut to so many characters."""
    text = F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), r"\s+", "_")
    return F.when(text != "", text if most is None else F.substring(text, 1, most))


def clean_objects(values: Column, most: int | None = None, length: int | None = None) -> Column:
    """Clean tags, each once in order; with ``most``, of the first so many."""
    cleaned = F.array_compact(F.transform(values, lambda v: clean_tag(v, length)))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(cleaned if most is None else F.slice(cleaned, 1, most)), empty)


def clean_notes(value: Column, most: int | None = None) -> Column:
    """Trimmed; empty is null. With ``most``, cut to so many characters."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(text != "", text if most is None else F.substring(text, 1, most))


def is_untagged(task: Column, scene: Column, objects: Column, notes: Column) -> Column:
    return task.isNull() & scene.isNull() & (F.size(objects) == 0) & notes.isNull()

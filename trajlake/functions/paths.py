"""Dataset paths: templates, layout, file groups, natural order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard layout of a version-3 dataset.
V3_DATA = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
V3_VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
GROUP_ORDER = {"data": 0, "episodes": 1, "meta": 2, "other": 3}


def padded(number: Column, width: int) -> Column:
    """Zero-padded to at least ``width`` digits; longer numbers stay whole."""
    text = number.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def fill_template(template: Column, **values: Column) -> Column:
    """Put values into ``{key}`` and ``{key:03d}`` places of a path template."""
    out = template
    for key, value in values.items():
        out = F.regexp_replace(out, F.lit(r"\{" + key + r"(:[^}]*)?\}"), value)
    return out


def is_resolved(path: Column) -> Column:
    return path.isNotNull() & ~path.rlike(r"\{[^}]+\}")


def v3_data_path(chunk: Column, file: Column) -> Column:
    return fill_template(F.lit(V3_DATA), chunk_index=padded(chunk, 3), file_index=padded(file, 3))


def v3_video_path(camera: Column, chunk: Column, file: Column) -> Column:
    return fill_template(
        F.lit(V3_VIDEO), video_key=camera, chunk_index=padded(chunk, 3), file_index=padded(file, 3)
    )


def v2_data_path(template: Column, episode: Column, chunks_size: Column) -> Column:
    return fill_template(
        template,
        episode_chunk=padded(F.floor(episode / chunks_size), 3),
        episode_index=padded(episode, 6),
    )


def file_group(path: Column) -> Column:
    return (
        F.when(path.startswith("meta/episodes/"), "episodes")
        .when(path.startswith("data/"), "data")
        .when(path.startswith("meta/"), "meta")
        .otherwise("other")
    )


def group_rank(group: Column) -> Column:
    out = F.lit(GROUP_ORDER["other"])
    for name, rank in GROUP_ORDER.items():
        out = F.when(group == name, rank).otherwise(out)
    return out


def natural_key(path: Column) -> Column:
    """Sort key in which digit runs compare as numbers."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p),
        ),
        "",
    )


def format_version(codebase_version: Column, has_v3_meta: Column, has_v2_meta: Column, data_paths: Column) -> Column:
    """v2 or v3 by the version text, else by which metadata exists, else by data file names."""
    return (
        F.when(codebase_version.startswith("v3"), "v3")
        .when(codebase_version.startswith("v2"), "v2")
        .when(has_v3_meta, "v3")
        .when(has_v2_meta, "v2")
        .when(F.exists(data_paths, lambda p: p.rlike(r"(?i)/file-\d+\.parquet$")), "v3")
        .when(F.exists(data_paths, lambda p: p.rlike(r"(?i)/episode_\d+\.parquet$")), "v2")
    )

"""Language atoms: text notes on an episode, by role and style."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The styles and the column each belongs to.
PERSISTENT_STYLES = ("task_aug", "subtask", "plan", "memory")
EVENT_STYLES = ("interjection", "vqa")
SPAN_STYLES = ("subtask", "plan")

ATOM_SCHEMA = (
    "role string, content string, style string, timestamp double, camera string, tool_calls string"
)


def target_column(style: Column) -> Column:
    """The column an atom of this style is stored in; an unknown style is an error."""
    return (
        F.when(style.isNull() | style.isin(*EVENT_STYLES), "language_events")
        .when(style.isin(*PERSISTENT_STYLES), "language_persistent")
        .otherwise(F.raise_error(F.concat(F.lit("Unknown style: "), style)))
    )


def is_speech(style: Column, role: Column, tool_calls: Column) -> Column:
    """An assistant atom without style whose first tool call is ``say``."""
    name = F.get_json_object(tool_calls, "$[0].function.name")
    return F.coalesce(style.isNull() & (role == "assistant") & (name == "say"), F.lit(False))


def speech_text(style: Column, role: Column, tool_calls: Column) -> Column:
    text = F.get_json_object(tool_calls, "$[0].function.arguments.text")
    return F.when(is_speech(style, role, tool_calls), text)


def matches_camera(camera: Column, wanted: str) -> Column:
    return camera.isNull() | (camera == wanted)


def vqa_kind(answer: Column) -> Column:
    """Kind of a question answer from the fields its JSON has; null when none fits."""
    v = F.try_parse_json(answer)

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def is_list(path):
        return kind(path).startswith("ARRAY")

    def is_text(path):
        return kind(path) == "STRING"

    def is_number(path):
        return kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|INT|DECIMAL)")

    def is_set(path):
        k = kind(path)
        return k.isNotNull() & (k != "VOID")

    return (
        F.when(is_list("$.detections"), "bbox")
        .when(is_set("$.point_format") & is_list("$.point"), "keypoint")
        .when(is_number("$.count") & is_text("$.label"), "count")
        .when(is_text("$.attribute") & is_set("$.value"), "attribute")
        .when(is_text("$.subject") & is_text("$.relation"), "spatial")
    )

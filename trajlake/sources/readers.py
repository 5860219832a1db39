"""Readers of recording datasets: frames, episode tables and metadata files.

Every reader takes a root that holds one or many datasets; the ``dataset``
column is the path below the root (``.`` when the root is itself a dataset).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.numbers import number_or_null
from trajlake.functions.paths import file_group, group_rank, natural_key
from trajlake.functions.vectors import quoted
from trajlake.operators import locate
from trajlake.operators.blocks import KEYS, positions
from trajlake.session import cut
from trajlake.sources import scan
from trajlake.sources.scan import relative

# Fixed names: bookkeeping columns of a frame table.
BOOKKEEPING = ("timestamp", "frame_index", "episode_index", "index", "task_index")
# Fixed names: directories that never hold datasets.
IGNORED = ("calibration", ".cache", ".git", "node_modules", "__pycache__")

INFO_SCHEMA = (
    "codebase_version string, fps string, total_episodes string, total_frames string, total_tasks string, "
    "chunks_size string, data_path string, video_path string, robot_type string, splits map<string,string>, "
    "features map<string, struct<dtype:string, shape:array<bigint>, names:string>>"
)


def dataset_of(path: Column, marker: str) -> Column:
    """The part of a relative path before the dataset's ``marker`` folder."""
    name = F.regexp_extract(path, rf"^(.*?)/?{marker}", 1)
    return F.when(name == "", F.lit(".")).otherwise(name)


def read_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole small text files below the root as ``(path, text)``."""
    raw = scan.texts_below(spark, root, glob)
    return raw.select(relative(root, F.col("path")).alias("path"), "text")


def data_templates(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, template)`` of the datasets below the root, from their info documents."""
    return top_datasets(read_infos(spark, root)).select("dataset", F.col("data_path").alias("template"))


def scan_plan(
    spark: SparkSession,
    root: str,
    columns: list[str] | None = None,
    wanted: DataFrame | None = None,
    part: str | None = None,
) -> list[scan.Group]:
    """The reads that cover the frame files below the root (see :mod:`trajlake.sources.scan`).

    ``wanted`` limits them to its ``dataset`` rows, or to its ``(dataset, file)`` rows if it has
    files. ``part`` takes files of another path template than the datasets' own.
    """
    listed = cut(scan.parquet_files(spark, root))
    templates = data_templates(spark, root)
    if part:
        templates = templates.withColumn("template", F.lit(part))
    chosen = scan.assigned(listed, templates, part or scan.ANY_DATA)
    if wanted is not None:
        keys = [c for c in ("dataset", "file") if c in wanted.columns]
        chosen = chosen.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return scan.groups(listed, cut(chosen), columns, root)


def read_frames(
    spark: SparkSession,
    root: str,
    columns: list[str] | None = None,
    renumber: bool = True,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Frame rows of all datasets below the root, in file order.

    Datasets may differ in layout and in stored types; only their frame files are opened,
    and of those only the bookkeeping columns and ``columns``. Footers are read while the
    plan is made. ``file`` is the path below the dataset. ``wanted`` limits the scan (see
    :func:`scan_plan`).

    A file that holds a single episode may leave ``episode_index`` out: it is then taken
    from the file's name. Rows whose episode neither tells are kept with a null episode and
    position. ``position`` numbers an episode's rows in file order; with ``renumber=False``
    the recorded ``frame_index`` is trusted instead, which saves a shuffle.
    """
    found = scan_plan(spark, root, None if columns is None else [*BOOKKEEPING, *columns], wanted)
    fixed = "dataset string, episode_index long, file string, position long"
    if not found:
        return spark.createDataFrame([], fixed)
    df = scan.read_groups(spark, root, found)
    names = [c for c in df.columns if c not in ("_dataset", "_file", "_episode", "_order", "_row")]
    own = [F.col("episode_index").cast("long")] if "episode_index" in names else []
    rest = [quoted(c) for c in names if c not in ("episode_index", "dataset", "file", "position")]
    frames = df.select(
        F.col("_dataset").alias("dataset"),
        F.coalesce(*own, F.col("_episode")).alias("episode_index"),
        *rest,
        F.col("_file").alias("file"),
        "_order",
        "_row",
        F.col("_episode").isNotNull().alias("_single"),
    )
    if not renumber:
        numbered = F.col("frame_index").cast("long") if "frame_index" in names else F.lit(None).cast("long")
        return frames.withColumn("position", numbered).drop("_row", "_order", "_single")
    # Files are in order of their chunk and file numbers; a file outside that
    # scheme holds one episode, whose rows are in order by themselves.
    along = F.when(F.col("_order") >= 0, F.col("_order") * 1e9 + F.col("_row")).when(
        F.col("_single"), F.col("_row").cast("double")
    ).otherwise(F.lit(0.0))
    known = frames.where(F.col("episode_index").isNotNull())
    numbered = positions(known, ["_order", "file", "_row"], along).drop("_row", "_order", "_single")
    unknown = frames.where(F.col("episode_index").isNull()).withColumn("position", F.lit(None).cast("long"))
    return numbered.unionByName(unknown.drop("_row", "_order", "_single"))


def read_located(spark: SparkSession, root: str, episodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Frames of the wanted ``episodes`` (normalised rows), found by their file and row range.

    Only files that some range names are opened. Where an episode's range holds none of
    its rows, its dataset is scanned again for the episode number in the data, and only
    such datasets are. ``rescanned`` tells which way a row was found; ``position`` counts an
    episode's rows in recorded order.
    """
    places = cut(locate.locators(episodes))
    first = read_frames(spark, root, columns, renumber=False, wanted=places)
    if "index" in first.columns:
        found = locate.rows_in_range(first.drop("position"), places)
    else:
        found = first.drop("position").join(places.select(*KEYS), KEYS, "left_semi")
    stale = cut(locate.stale_datasets(places, found))
    parts = [found.join(stale, "dataset", "left_anti").withColumn("rescanned", F.lit(False))]
    if not stale.isEmpty():
        again = read_frames(spark, root, columns, renumber=False, wanted=stale).drop("position")
        again = again.join(places.select(*KEYS).distinct(), KEYS, "left_semi")
        both = found.select(*KEYS).distinct().groupBy("dataset").agg(F.count("*").alias("_ranged"))
        better = cut(
            again.select(*KEYS).distinct().groupBy("dataset").agg(F.count("*").alias("_numbered"))
            .join(both, "dataset", "left").where(F.col("_numbered") > F.coalesce("_ranged", F.lit(0))).select("dataset")
        )
        parts.append(again.join(better, "dataset", "left_semi").withColumn("rescanned", F.lit(True)))
        kept = found.join(stale, "dataset", "left_semi").join(better, "dataset", "left_anti")
        parts.append(kept.withColumn("rescanned", F.lit(False)))
    out = parts[0]
    for part in parts[1:]:
        out = scan.united(out, part)
    order = [c for c in ("index", "frame_index", "timestamp") if c in out.columns]
    return positions(out, order, F.col(order[0])) if order else out


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episode rows from parquet metadata, as stored (see :func:`normalise_episodes`).

    Tables of different stored types are read apart and united.
    """
    found = scan_plan(spark, root, part=scan.EPISODE_TABLES)
    if not found:
        return spark.createDataFrame([], "dataset string, episode_index long")
    df = scan.read_groups(spark, root, found)
    return df.drop("dataset", "_file", "_episode", "_order", "_row").withColumnRenamed("_dataset", "dataset")


def read_columns(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, file, column, type, kind)`` of every frame file, from the files' footers alone."""
    chosen = scan.assigned(scan.parquet_files(spark, root), data_templates(spark, root))
    return scan.file_columns(scan.footers(chosen, root))


def read_episodes_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """Episode rows from line-JSON metadata; blank and non-object lines are skipped."""
    return parse_episode_lines(read_lines(spark, root, "episodes.jsonl"))


def parse_episode_lines(lines: DataFrame) -> DataFrame:
    """Episode rows of ``(dataset, line)`` rows."""
    schema = "episode_index string, length string, num_frames string, tasks array<string>"
    row = F.from_json(F.trim("line"), schema)
    return lines.where(F.trim("line").startswith("{")).select("dataset", row.alias("_r")).select("dataset", "_r.*")


# Fixed layout: what the columns "0".."9" of an old episode table hold.
NUMBERED = {
    "episode_index": "0",
    "data/chunk_index": "1",
    "data/file_index": "2",
    "dataset_from_index": "3",
    "dataset_to_index": "4",
    "video_chunk_index": "5",
    "video_file_index": "6",
    "video_from_timestamp": "7",
    "video_to_timestamp": "8",
    "length": "9",
}


def normalise_episodes(df: DataFrame) -> DataFrame:
    """One layout for named and numbered episode tables.

    The first camera's columns are the episode's own video columns; an unknown
    video end is 30 s; the length comes from ``length``, ``"9"`` or ``num_frames``.
    """
    have = set(df.columns)
    cameras = cameras_of(df)

    def number(*names: str) -> Column:
        found = [number_or_null(quoted(n)) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    def whole(default: int, *names: str) -> Column:
        return F.coalesce(number(*names), F.lit(float(default))).cast("long")

    first = cameras[0] if cameras else None

    def video(field: str, plain: str) -> list[str]:
        own = [f"videos/{first}/{field}"] if first else []
        return [*own, plain, NUMBERED[plain]]

    end = number(*video("to_timestamp", "video_to_timestamp"))
    tasks = (
        F.coalesce(quoted("tasks").cast("array<string>"), F.array().cast("array<string>"))
        if "tasks" in have
        else F.array().cast("array<string>")
    )
    start = whole(0, "dataset_from_index", "3")
    length = F.greatest(F.lit(0), whole(0, "length", "9", "num_frames"))
    camera_cols = [quoted(c) for c in df.columns if c.startswith("videos/")]
    return df.select(
        "dataset",
        whole(0, "episode_index", "0").alias("episode_index"),
        whole(0, "data/chunk_index", "1").alias("data_chunk"),
        whole(0, "data/file_index", "2").alias("data_file"),
        start.alias("from_index"),
        F.coalesce(number("dataset_to_index", "4").cast("long"), start + length).alias("to_index"),
        length.alias("length"),
        whole(0, *video("chunk_index", "video_chunk_index")).alias("video_chunk"),
        whole(0, *video("file_index", "video_file_index")).alias("video_file"),
        F.coalesce(number(*video("from_timestamp", "video_from_timestamp")), F.lit(0.0)).alias("video_start"),
        F.coalesce(F.when(end != 0, end), F.lit(30.0)).alias("video_end"),
        F.array_compact(tasks).alias("tasks"),
        *camera_cols,
    )


def cameras_of(df: DataFrame) -> list[str]:
    names = []
    for c in df.columns:
        if c.startswith("videos/") and c.endswith("/chunk_index"):
            names.append(c[len("videos/") : -len("/chunk_index")])
    return names


def episode_videos(episodes: DataFrame, cameras: list[str]) -> DataFrame:
    """One row per episode and camera: where its video lies and its time span.

    A camera without columns of its own shares the episode's.
    """
    have = set(episodes.columns)
    entries = []
    for cam in cameras:
        def own(field, shared, default):
            name = f"videos/{cam}/{field}"
            value = number_or_null(quoted(name)) if any(c.startswith(f"videos/{cam}/") for c in have) and name in have else F.col(shared).cast("double")
            return F.coalesce(value, F.lit(float(default)))

        end = own("to_timestamp", "video_end", 30)
        entries.append(
            F.struct(
                F.lit(cam).alias("camera"),
                own("chunk_index", "video_chunk", 0).cast("long").alias("chunk"),
                own("file_index", "video_file", 0).cast("long").alias("file"),
                own("from_timestamp", "video_start", 0).alias("start"),
                F.when(end == 0, F.lit(30.0)).otherwise(end).alias("end"),
            )
        )
    out = episodes.select(*KEYS, F.explode(F.array(*entries)).alias("_v")).select(*KEYS, "_v.*")
    return out.withColumn("duration", F.col("end") - F.col("start"))


def read_infos(spark: SparkSession, root: str) -> DataFrame:
    """One typed row per ``meta/info.json``, with the raw text and its key list.

    An unreadable document leaves a row whose ``error`` says so.
    """
    texts = read_texts(spark, root, "info.json").where(F.col("path").rlike(r"(^|/)meta/info\.json$"))
    return parse_infos(texts.withColumn("dataset", dataset_of(F.col("path"), "meta/")))


def parse_infos(texts: DataFrame) -> DataFrame:
    """Parse ``(dataset, text)`` rows of info documents."""
    parsed = F.from_json("text", INFO_SCHEMA)
    is_object = F.get_json_object("text", "$").startswith("{")
    i = F.col("_i")

    def text_or_null(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    def count(c: Column) -> Column:
        return number_or_null(c).cast("long")

    return texts.withColumn("_i", parsed).select(
        "dataset",
        text_or_null(i.codebase_version).alias("codebase_version"),
        number_or_null(i.fps).alias("fps"),
        count(i.total_episodes).alias("total_episodes"),
        count(i.total_frames).alias("total_frames"),
        count(i.total_tasks).alias("total_tasks"),
        F.greatest(F.lit(1), F.coalesce(count(i.chunks_size), F.lit(1000))).cast("long").alias("chunks_size"),
        text_or_null(i.data_path).alias("data_path"),
        text_or_null(i.video_path).alias("video_path"),
        text_or_null(i.robot_type).alias("robot_type"),
        i.splits.alias("splits"),
        i.features.alias("features"),
        F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")).alias("keys"),
        F.when(~F.coalesce(is_object, F.lit(False)), F.lit("info.json could not be loaded")).alias("error"),
    )


def features_of(infos: DataFrame) -> DataFrame:
    """Declared features: ``(dataset, feature, dtype, shape, names)``."""
    return infos.select("dataset", F.explode("features").alias("feature", "_f")).select(
        "dataset", "feature", "_f.dtype", "_f.shape", "_f.names"
    )


def feature_names(features: DataFrame) -> DataFrame:
    """``(dataset, feature, dim, name)`` of one-dimensional numeric features.

    Names may be a list or an object whose first value holds the list (at any
    depth); without a list the name is the index.
    """
    listed = F.from_json(F.regexp_extract("names", r"(\[[^\[\]]*\])", 1), "array<string>")
    width = F.coalesce(F.get("shape", F.lit(0)), F.lit(1)).cast("int")
    index = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: i.cast("string"))
    return features.select(
        "dataset", "feature", F.posexplode(F.coalesce(listed, index)).alias("dim", "name")
    )


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, task_index, task)``: per dataset from parquet, else line JSON, else JSON.

    Text comes from ``__index_level_0__``, else ``task``.
    """
    parts = []
    try:
        table = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", "tasks.parquet")
            .option("mergeSchema", True)
            .parquet(root)
        )
        names = [n for n in ("__index_level_0__", "task") if n in table.columns]
        parts.append(
            table.select(
                dataset_of(relative(root, F.col("_metadata.file_path")), "meta/").alias("dataset"),
                F.col("task_index").cast("long").alias("task_index"),
                F.coalesce(*[F.col(n).cast("string") for n in names]).alias("task"),
            )
        )
    except Exception as error:  # no such file below the root
        if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "PATH_NOT_FOUND" not in str(error):
            raise
    parts.append(parse_task_lines(read_lines(spark, root, "tasks.jsonl")))
    documents = read_texts(spark, root, "tasks.json").withColumn("dataset", dataset_of(F.col("path"), "meta/"))
    parts.append(parse_task_document(documents))
    out = None
    for part in parts:
        if out is None:
            out = part
        else:
            out = out.unionByName(part.join(out.select("dataset").distinct(), "dataset", "left_anti"))
    return out


def read_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.select(
        dataset_of(relative(root, F.col("_metadata.file_path")), "meta/").alias("dataset"),
        F.trim("value").alias("line"),
    )


TASK_SCHEMA = "task_index bigint, task string, __index_level_0__ string"


def parse_task_lines(lines: DataFrame) -> DataFrame:
    row = F.from_json("line", TASK_SCHEMA)
    return (
        lines.where(F.col("line").startswith("{"))
        .select("dataset", row.alias("_t"))
        .select("dataset", "_t.task_index", F.coalesce("_t.__index_level_0__", "_t.task").alias("task"))
    )


def parse_task_document(documents: DataFrame) -> DataFrame:
    """Task JSON: an array of records, one record, or an index-to-text map."""
    body = F.trim("text")
    listed = F.from_json(F.when(body.startswith("["), body), f"array<struct<{TASK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    one = F.from_json(F.when(body.startswith("{"), body), TASK_SCHEMA)
    mapped = F.from_json(F.when(body.startswith("{"), body), "map<string,string>")
    is_record = F.coalesce(F.map_contains_key(mapped, "task_index"), F.lit(False))
    from_map = F.transform(
        F.map_entries(mapped),
        lambda e: F.struct(
            e["key"].try_cast("bigint").alias("task_index"),
            e["value"].alias("task"),
            F.lit(None).cast("string").alias("__index_level_0__"),
        ),
    )
    rows = F.coalesce(listed, F.when(is_record, F.array(one)).otherwise(from_map))
    return documents.select("dataset", F.explode(rows).alias("_t")).select(
        "dataset", "_t.task_index", F.coalesce("_t.__index_level_0__", "_t.task").alias("task")
    )


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    texts = read_texts(spark, root, "stats.json").withColumn("dataset", dataset_of(F.col("path"), "meta/"))
    return parse_stats(texts)


def parse_stats(texts: DataFrame) -> DataFrame:
    """``(dataset, feature, field, dim, value)`` of stats documents; scalars are dim 0."""
    fields = texts.select(
        "dataset", F.explode(F.from_json("text", "map<string, map<string, string>>")).alias("feature", "_f")
    ).select("dataset", "feature", F.explode("_f").alias("field", "_v"))
    flat = F.split(F.regexp_replace("_v", r"[\[\]\s]", ""), ",")
    return fields.select("dataset", "feature", "field", F.posexplode(flat).alias("dim", "_x")).select(
        "dataset", "feature", "field", "dim", F.col("_x").try_cast("double").alias("value")
    )


def discover(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """Datasets, down to ``depth`` folders if given: folders with a versioned info document.

    Dot folders and ignored folders are skipped, and nothing below a dataset
    counts as another one.
    """
    return top_datasets(read_infos(spark, root), depth)


def top_datasets(infos: DataFrame, depth: int | None = None) -> DataFrame:
    """The info rows that count as datasets by their place (see :func:`discover`)."""
    infos = infos.where(F.col("codebase_version").isNotNull() & (F.col("dataset") != "."))
    parts = F.split("dataset", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED))
    infos = infos.where(~hidden if depth is None else (F.size(parts) <= depth) & ~hidden)
    parents = infos.select("dataset", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_k")).select(
        "dataset", F.array_join(F.slice(parts, F.lit(1), F.col("_k")), "/").alias("_parent")
    ).where(F.col("_parent") != F.col("dataset"))
    tops = infos.select(F.col("dataset").alias("_parent"))
    nested = parents.join(tops, "_parent").select("dataset").distinct()
    return infos.join(nested, "dataset", "left_anti")


def read_inventory(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Files below the root: ``(path, size, modified)``, and ``truncated`` past the limit, if one is given.

    Only file listings are read, never contents.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            relative(root, F.col("path")).alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
    )
    if limit is None:
        return files.withColumn("truncated", F.lit(False))
    over = files.limit(limit + 1).agg(F.count("*") > limit).scalar()
    return files.limit(limit).withColumn("truncated", over)


def list_parquet(inventory: DataFrame) -> DataFrame:
    """Parquet files by group, in natural path order; media folders are left out."""
    keep = F.lower("path").endswith(".parquet") & ~F.col("path").rlike(r"(^|/)(videos|images)/")
    listed = inventory.where(keep).withColumn("group", file_group(F.col("path")))
    listed = listed.withColumns({"_g": group_rank(F.col("group")), "natural_key": natural_key(F.col("path"))})
    return listed.orderBy("_g", "natural_key").drop("_g")


def table_profile(df: DataFrame) -> DataFrame:
    """Row count and columns of every file of a parquet table."""
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.nullable).alias("nullable"),
            )
            for f in df.schema.fields
        ]
    )
    per_file = df.groupBy(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count("*").alias("rows"))
    return per_file.select("file", "size", "rows", F.explode(columns).alias("_c")).select(
        "file", "size", "rows", "_c.*"
    )


# Fixed names: progress columns in the order they are preferred.
PROGRESS_FILES = ("sarm_progress.parquet", "srm_progress.parquet")
PROGRESS_COLUMNS = ("progress_sparse", "progress_dense", "progress")


def pick_progress(rows: DataFrame) -> DataFrame:
    """Per episode, the first preferred progress column that has a finite value, as ``progress``.

    The order is sparse, dense, plain, then other ``progress_*`` columns by name.
    """
    have = [c for c in PROGRESS_COLUMNS if c in rows.columns]
    have += sorted(c for c in rows.columns if c.startswith("progress_") and c not in have)
    usable = [F.bool_or(number_or_null(quoted(c)).isNotNull()).alias(c) for c in have]
    chosen = F.coalesce(*[F.when(quoted(c), F.lit(c)) for c in have])
    per = rows.groupBy(*KEYS).agg(*usable).select(*KEYS, chosen.alias("series"))
    value = F.coalesce(*[F.when(F.col("series") == c, number_or_null(quoted(c))) for c in have])
    order = [number_or_null(quoted(c)) for c in ("index", "frame_index") if c in rows.columns]
    out = rows.join(per.where(F.col("series").isNotNull()), KEYS).withColumn("progress", value)
    return out.where(F.col("progress").isNotNull()).select(
        *KEYS,
        "series",
        F.coalesce(*order, F.lit(0.0)).alias("order"),
        "progress",
    )


def read_progress(spark: SparkSession, root: str) -> DataFrame | None:
    """Progress rows of the first progress file found; None without one."""
    for name in PROGRESS_FILES:
        try:
            df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).parquet(root)
        except Exception as error:  # no such file below the root
            if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        where = relative(root, F.col("_metadata.file_path"))
        folder = F.regexp_replace(where, r"/?[^/]+$", "")
        return df.withColumn("dataset", F.when(folder == "", F.lit(".")).otherwise(folder))
    return None

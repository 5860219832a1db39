"""Queries over readers, sidecars, sinks, series and small column functions."""

import json
import uuid

from pyspark.sql import functions as F

from trajlake.functions import paths, tags, vectors
from trajlake.functions.numbers import number_or_null, round_half_up
from trajlake.operators import locate, segments, series
from trajlake.operators import stats as stats_ops
from trajlake.operators.blocks import KEYS, positions
from trajlake.operators.corpus import inventory_totals
from trajlake.plans.oracle import CATALOG, EV, LI, LI_LONG, ORD, r, sql
from trajlake.plans.q_language import VOCAB, vocab
from trajlake.plans.q_stats import rounded
from trajlake.plans.registry import query
from trajlake.plans.views import (
    catalog,
    emb_frames,
    ev_frames,
    event_segments,
    event_tasks,
    li_frames,
    order_episodes,
    order_info_texts,
    order_inventory,
    sidecar_texts,
    table,
)
from trajlake.session import cut, cut_once, shared_folder
from trajlake.sources import readers, sidecars, sinks


def fresh_path(spark) -> str:
    return f"{shared_folder(spark)}/trajlake-{uuid.uuid4().hex}"


# ---- readers -------------------------------------------------------------------------


@query(
    "s01_frame_scan",
    sql(
        LI,
        f"""SELECT dataset, episode_index, position, {r('position / 10.0')} AS timestamp, q AS first_value FROM li""",
    ),
)
def frame_scan(spark, sf):
    # The trajectories stored as recordings: one folder per dataset, files in row order.
    root = fresh_path(spark)
    frames = li_frames(spark, sf).withColumnRenamed("observation.state", "state")
    for name in ("A", "N", "R"):
        own = frames.where(F.col("dataset") == name).drop("dataset", "position")
        ordered = own.repartitionByRange("episode_index", "frame_index").sortWithinPartitions(
            "episode_index", "frame_index"
        )
        ordered.write.parquet(f"{root}/{name}/data/chunk-000")
    out = readers.read_frames(spark, root, ["action"])
    return rounded(
        out.select(*KEYS, "position", "timestamp", F.col("action")[0].alias("first_value")), "timestamp"
    )


V2_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"


def write_info(spark, root, dataset, version, data_path):
    info = {"codebase_version": version, "fps": 10, "data_path": data_path, "features": {"action": {"dtype": "float32", "shape": [3]}}}
    sinks.write_text(spark, f"{root}/{dataset}/meta/info.json", json.dumps(info))


def mixed_root(spark, sf):
    """Three recordings under one root that share neither layout nor stored types.

    A: shared files of float vectors. N: a file per episode with no episode numbers, whole
    numbers as int. R: a file per episode of double vectors. Each has tables beside its
    frames that are none.
    """

    def build():
        root = fresh_path(spark)
        frames = li_frames(spark, sf).select(*KEYS, "position", "frame_index", "timestamp", "task_index", "action")
        f = frames.withColumn("_along", F.col("episode_index"))
        g = positions(f, ["episode_index", "position"], F.col("_along"), ["dataset"], "index").drop("_along")
        shared = paths.v3_data_path(F.floor(F.col("episode_index") / 50), F.floor(F.col("episode_index") / 10))
        own = paths.v2_data_path(F.lit(V2_PATH), F.col("episode_index"), F.lit(1000))
        whole = cut(g.withColumn("file", F.when(F.col("dataset") == "A", shared).otherwise(own)))
        a = whole.where("dataset = 'A'").withColumn("action", F.col("action").cast("array<float>")).drop("dataset", "position")
        n = whole.where("dataset = 'N'").withColumn("frame_index", F.col("frame_index").cast("int")).drop("dataset", "position", "episode_index")
        for name, rows in (("A", a), ("N", n), ("R", whole.where("dataset = 'R'").drop("dataset", "position"))):
            sinks.write_files(rows, f"{root}/{name}", order=["index"])
        other = spark.createDataFrame([("not frames", "meta/extra.parquet"), ("nor these", "data/notes/list.parquet")], "action string, file string")
        for name, version, path in (("A", "v3.0", paths.V3_DATA), ("N", "v2.1", V2_PATH), ("R", "v2.0", V2_PATH)):
            sinks.write_files(other, f"{root}/{name}")
            write_info(spark, root, name, version, path)
        return spark.createDataFrame([(root,)], "root string")

    return cut_once("mixed_root", sf, build).first()["root"]


@query(
    "s02_frame_scan_v2",
    sql(
        LI,
        f"""SELECT dataset, episode_index, position, {r('position / 10.0')} AS timestamp, q AS first_value,
  CASE WHEN dataset = 'A' THEN 'data/chunk-' || lpad(CAST(episode_index // 50 AS VARCHAR), 3, '0') || '/file-' || lpad(CAST(episode_index // 10 AS VARCHAR), 3, '0')
       ELSE 'data/chunk-' || lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0') || '/episode_' || lpad(CAST(episode_index AS VARCHAR), 6, '0') END || '.parquet' AS file
FROM li""",
    ),
)
def frame_scan_v2(spark, sf):
    out = readers.read_frames(spark, mixed_root(spark, sf), ["action"])
    return rounded(
        out.select(*KEYS, "position", "timestamp", F.col("action")[0].cast("double").alias("first_value"), "file"), "timestamp"
    )


@query(
    "u02_file_columns",
    sql(
        LI,
        """SELECT dataset, file, c AS "column", CASE WHEN c = 'action' THEN CASE dataset WHEN 'A' THEN 'float' ELSE 'double' END
    WHEN c = 'timestamp' THEN 'double' WHEN c = 'frame_index' AND dataset = 'N' THEN 'integer' ELSE 'long' END AS kind
FROM (SELECT DISTINCT dataset, CASE WHEN dataset = 'A' THEN 'data/chunk-' || lpad(CAST(episode_index // 50 AS VARCHAR), 3, '0') || '/file-' || lpad(CAST(episode_index // 10 AS VARCHAR), 3, '0')
       ELSE 'data/chunk-' || lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0') || '/episode_' || lpad(CAST(episode_index AS VARCHAR), 6, '0') END || '.parquet' AS file FROM li),
  unnest(['action', 'timestamp', 'frame_index', 'index', 'task_index', 'episode_index']) AS u(c) WHERE NOT (dataset = 'N' AND c = 'episode_index')""",
    ),
)
def file_columns(spark, sf):
    return readers.read_columns(spark, mixed_root(spark, sf)).select("dataset", "file", "column", "kind")


@query(
    "j01_located_load",
    sql(
        LI + """,
gx AS (SELECT dataset, episode_index, position, q, row_number() OVER (PARTITION BY dataset ORDER BY episode_index, position) - 1 AS gi FROM li)""",
        """SELECT dataset, episode_index, dataset = 'R' AS rescanned, count(*) AS frames, CAST(sum(gi) AS BIGINT) AS index_sum,
  CAST(max(position) AS BIGINT) AS last_position FROM gx WHERE episode_index % 3 = 0 GROUP BY 1, 2""",
    ),
)
def located_load(spark, sf):
    # Every third episode by its place; the places of one dataset name files that do not exist.
    root = mixed_root(spark, sf)
    f = li_frames(spark, sf).select(*KEYS, "position").withColumn("_along", F.col("episode_index"))
    g = positions(f, ["episode_index", "position"], F.col("_along"), ["dataset"], "index")
    spans = g.groupBy(*KEYS).agg(F.min("index").alias("from_index"), (F.max("index") + 1).alias("to_index"))
    shared = paths.v3_data_path(F.floor(F.col("episode_index") / 50), F.floor(F.col("episode_index") / 10))
    own = paths.v2_data_path(F.lit(V2_PATH), F.col("episode_index"), F.lit(1000))
    lost = F.lit("data/chunk-009/file-999.parquet")
    file = F.when(F.col("dataset") == "A", shared).when(F.col("dataset") == "N", own).otherwise(lost)
    episodes = spans.where("episode_index % 3 = 0").withColumn("file", file)
    out = readers.read_located(spark, root, episodes, ["action"])
    return out.groupBy(*KEYS, "rescanned").agg(
        F.count("*").alias("frames"), F.sum("index").alias("index_sum"), F.max("position").alias("last_position")
    )


@query(
    "s03_episode_metadata",
    sql(LI, "SELECT dataset, episode_index, count(*) AS length FROM li GROUP BY 1, 2"),
)
def episode_metadata(spark, sf):
    # Episode tables of three datasets, each in several files.
    root = fresh_path(spark)
    lengths = cut(li_frames(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("length")))
    for name in ("A", "N", "R"):
        own = lengths.where(F.col("dataset") == name).drop("dataset")
        own.repartitionByRange("episode_index").write.parquet(f"{root}/{name}/meta/episodes/chunk-000")
    return readers.normalise_episodes(readers.read_episodes(spark, root)).select(*KEYS, "length")


@query(
    "s04_episode_lines",
    """SELECT 'c' || o_custkey AS dataset, CAST(o_orderkey AS VARCHAR) AS episode_index, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS length
FROM orders WHERE o_orderstatus <> 'P'""",
)
def episode_lines(spark, sf):
    # One line per order; the lines of one status are blank or not an object.
    o = table(spark, sf, "orders")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("episode_index"), F.floor("o_totalprice").alias("length")))
    bad = F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("[1]"))
    line = F.when(F.col("o_orderstatus") == "P", bad).otherwise(F.concat(record, F.lit(" ")))
    lines = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("dataset"), line.alias("line"))
    return readers.parse_episode_lines(lines).select("dataset", "episode_index", "length")


@query(
    "s09_catalog_discovery",
    sql(
        CATALOG,
        """SELECT CASE WHEN fps > 0 THEN path ELSE path || '/extra' END AS dataset FROM catalog WHERE total_episodes > 0 AND split_part(path, '/', 1) || '/' || split_part(path, '/', 2) NOT IN
  (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM catalog WHERE total_episodes > 22)
UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM catalog WHERE total_episodes > 22""",
    ),
)
def catalog_discovery(spark, sf):
    # Info documents at customer folders; a busy customer makes its nation's folder a
    # dataset, which hides those below. Some lie in an ignored folder; then the one below counts.
    c = catalog(spark, sf).where("total_episodes > 0")
    nation = F.substring_index("path", "/", 2)
    hidden = F.concat(nation, F.lit("/.cache"))
    deep = F.concat("path", F.lit("/extra"))
    version = F.lit("v3.0").alias("codebase_version")
    infos = c.select(F.when(F.col("fps") > 0, F.col("path")).otherwise(hidden).alias("dataset"), version)
    infos = infos.unionByName(c.select(deep.alias("dataset"), version))
    busy = c.where("total_episodes > 22").select(nation.alias("dataset"), version).distinct()
    return readers.top_datasets(infos.unionByName(busy)).select("dataset").distinct()


@query(
    "s05_episode_rows",
    sql(
        ORD,
        """SELECT dataset, episode_index, CASE WHEN st = 'P' THEN 0 ELSE episode_index // 7 END AS data_chunk, episode_index % 7 AS data_file,
  episode_index * 100 AS from_index, episode_index * 100 + CASE WHEN st = 'O' THEN 55 ELSE length END AS to_index, length,
  CASE WHEN st = 'F' THEN 0 ELSE length END AS video_chunk, CASE WHEN st = 'F' THEN 30.0 ELSE length / 10.0 END AS video_end, len(tasks) AS tasks
FROM (SELECT *, CASE WHEN st = 'O' THEN ['a', 'b'] ELSE [] END AS tasks FROM oe)""",
    ),
)
def episode_rows(spark, sf):
    rows = episode_rows_raw(spark, sf)
    out = readers.normalise_episodes(rows)
    return out.select(
        *KEYS, "data_chunk", "data_file", "from_index", "to_index", "length", "video_chunk", "video_end",
        F.size("tasks").cast("long").alias("tasks"),
    )


def episode_rows_raw(spark, sf):
    """Episode metadata with text numbers, gaps, and one camera's columns."""
    e = order_episodes(spark, sf)
    st = F.col("o_orderstatus")
    return e.select(
        "dataset",
        F.col("episode_index").cast("string").alias("episode_index"),
        F.when(st == "P", F.lit("n/a")).otherwise(F.floor(F.col("episode_index") / 7).cast("string")).alias("data/chunk_index"),
        (F.col("episode_index") % 7).alias("data/file_index"),
        (F.col("episode_index") * 100).cast("double").alias("dataset_from_index"),
        F.when(st == "O", F.col("episode_index") * 100 + 55).alias("dataset_to_index"),
        F.lit(None).cast("long").alias("length"),
        F.col("length").alias("num_frames"),
        F.when(st != "F", F.col("length")).alias("videos/top/chunk_index"),
        F.lit(3).alias("videos/top/file_index"),
        F.when(st != "F", F.col("length") / 10.0).otherwise(F.lit(0.0)).alias("videos/top/to_timestamp"),
        F.when(st == "O", F.array(F.lit("a"), F.lit("b"), F.lit(None))).alias("tasks"),
    )


@query(
    "p16_episode_cameras",
    sql(
        ORD,
        """SELECT dataset, episode_index, camera, CASE WHEN st = 'F' THEN 0 ELSE length END AS chunk, CAST(3 AS BIGINT) AS file,
  CAST(0 AS DOUBLE) AS start, CASE WHEN st = 'F' THEN 30.0 ELSE length / 10.0 END AS "end", CASE WHEN st = 'F' THEN 30.0 ELSE length / 10.0 END AS duration
FROM oe CROSS JOIN (SELECT unnest(['top', 'wrist']) AS camera)""",
    ),
)
def episode_cameras(spark, sf):
    return readers.episode_videos(readers.normalise_episodes(episode_rows_raw(spark, sf)), ["top", "wrist"])


@query(
    "j22_frame_overview",
    sql(
        ORD
        + """, rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY episode_index) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS m FROM oe),
pk AS (SELECT DISTINCT dataset, CAST(floor(g * (m - 1) / 9.0 + 0.5) AS BIGINT) AS i FROM rk, (SELECT unnest(range(0, 10)) AS g) WHERE m > 10)""",
        """SELECT dataset, episode_index, 'videos/top/chunk-' || lpad(CAST(CASE WHEN st = 'F' THEN 0 ELSE length END AS VARCHAR), 3, '0') || '/file-003.mp4' AS path,
  CAST(0 AS DOUBLE) AS first_time, greatest(0, CASE WHEN st = 'F' THEN 30.0 ELSE length / 10.0 END - 0.05) AS last_time
FROM rk LEFT JOIN pk USING (dataset, i) WHERE m <= 10 OR pk.i IS NOT NULL""",
    ),
)
def frame_overview(spark, sf):
    videos = readers.episode_videos(readers.normalise_episodes(episode_rows_raw(spark, sf)), ["top"])
    return locate.frame_overview(cut(videos), sample=10).drop("camera")


@query(
    "s06_dataset_info",
    sql(
        ORD,
        """SELECT dataset, CASE WHEN bal > 8000 THEN 'v1.9' ELSE 'v3.0' END AS codebase_version, CAST(CASE WHEN bal < -500 THEN 0 ELSE 10 END AS DOUBLE) AS fps,
  CASE WHEN seg <> 'BUILDING' THEN eps + CASE WHEN bal < 0 THEN 1 ELSE 0 END END AS total_episodes, CAST(1000 AS BIGINT) AS chunks_size,
  CAST(2 + CASE WHEN bal > 0 THEN 1 ELSE 0 END + CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS BIGINT) AS features FROM oi""",
    ),
)
def dataset_info(spark, sf):
    infos = readers.parse_infos(order_info_texts(spark, sf))
    return infos.select(
        "dataset", "codebase_version", "fps", "total_episodes", "chunks_size", F.size("features").cast("long").alias("features")
    )


@query(
    "p02_chartable_features",
    sql(
        ORD,
        """SELECT dataset, feature, CAST(dim AS INT) AS dim, name FROM oi CROSS JOIN (SELECT unnest(['action', 'action', 'observation.state', 'observation.state']) AS feature,
    unnest([0, 1, 0, 1]) AS dim, unnest(['joint', 'grip', '0', '1']) AS name)
UNION ALL SELECT dataset, 'observation.force', CAST(d AS INT), CAST(d AS VARCHAR) FROM oi CROSS JOIN (SELECT unnest(range(0, 6)) AS d) WHERE bal > 5000""",
    ),
)
def chartable_features(spark, sf):
    features = readers.features_of(readers.parse_infos(order_info_texts(spark, sf)))
    return readers.feature_names(series.chartable(features))


@query(
    "s07_task_table",
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset, c_mktsegment AS seg, c_name AS nm FROM customer)
SELECT dataset, CAST(k AS BIGINT) AS task_index, CASE k WHEN 0 THEN seg ELSE nm END AS task FROM c CROSS JOIN (SELECT unnest([0, 1]) AS k)
  WHERE seg IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT dataset, 5, nm FROM c WHERE seg NOT IN ('BUILDING', 'MACHINERY')""",
)
def task_table(spark, sf):
    # Task documents in the three JSON forms: a map, an array of records, one record.
    c = table(spark, sf, "customer")
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    as_map = F.to_json(F.create_map(F.lit("0"), seg, F.lit("1"), name))
    record = F.struct(F.lit(0).alias("task_index"), seg.alias("task"), F.lit(None).cast("string").alias("__index_level_0__"))
    other = F.struct(F.lit(1).alias("task_index"), F.lit("x").alias("task"), name.alias("__index_level_0__"))
    one = F.struct(F.lit(5).alias("task_index"), name.alias("task"))
    text = F.when(seg == "BUILDING", as_map).when(seg == "MACHINERY", F.to_json(F.array(record, other))).otherwise(F.to_json(one))
    return readers.parse_task_document(c.select(F.col("c_custkey").cast("string").alias("dataset"), text.alias("text")))


@query(
    "s08_stored_stats",
    """SELECT CAST(c_custkey AS VARCHAR) AS dataset, 'action' AS feature, field, CAST(dim AS INT) AS dim,
  CASE WHEN field = 'std' THEN c_acctbal + dim ELSE CAST(c_nationkey AS DOUBLE) END AS value
FROM customer CROSS JOIN (SELECT unnest(['std', 'std', 'count']) AS field, unnest([0, 1, 0]) AS dim)""",
)
def stored_stats(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.col("c_acctbal")
    doc = F.struct(
        F.struct(F.array(bal, bal + 1).alias("std"), F.col("c_nationkey").alias("count")).alias("action")
    )
    return readers.parse_stats(c.select(F.col("c_custkey").cast("string").alias("dataset"), F.to_json(doc).alias("text")))


@query("s10_inventory")
def inventory(spark, sf):
    return readers.read_inventory(spark, sf).select("path", "size", "truncated")


@query(
    "s11_parquet_listing",
    sql(
        ORD,
        """SELECT dataset, path, CASE WHEN starts_with(path, 'meta/episodes/') THEN 'episodes' ELSE 'data' END AS "group", size FROM inv WHERE NOT starts_with(path, 'videos/')""",
    ),
)
def parquet_listing(spark, sf):
    return readers.list_parquet(order_inventory(spark, sf)).select("dataset", "path", "group", "size")


@query(
    "s12_table_profile",
    """SELECT 'orders.parquet' AS file, (SELECT count(*) FROM orders) AS rows, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name,
  unnest(['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string']) AS type""",
)
def table_profile(spark, sf):
    return readers.table_profile(table(spark, sf, "orders")).select("file", "rows", "name", "type")


@query(
    "f25_format_version",
    sql(
        ORD,
        "SELECT dataset, 'v3' AS format FROM oi",
    ),
)
def format_version(spark, sf):
    from trajlake.checks.files import detect_format

    infos = readers.parse_infos(order_info_texts(spark, sf))
    return detect_format(infos, order_inventory(spark, sf)).select("dataset", "format")


@query(
    "f08_file_groups",
    sql(ORD, """SELECT dataset, CASE WHEN starts_with(path, 'meta/episodes/') THEN 'episodes' WHEN starts_with(path, 'data/') THEN 'data' ELSE 'other' END AS "group",
  count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inv GROUP BY 1, 2"""),
)
def file_groups(spark, sf):
    inv = order_inventory(spark, sf)
    return inv.groupBy("dataset", paths.file_group(F.col("path")).alias("group")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


@query(
    "f04_path_templates",
    """SELECT o_orderkey, 'videos/top/chunk-' || lpad(CAST(o_orderkey // 1000 AS VARCHAR), 3, '0') || '/episode_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.mp4' AS path,
  'data/chunk-' || CASE WHEN o_custkey < 1000 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0') ELSE CAST(o_custkey AS VARCHAR) END || '/file-007.parquet' AS v3 FROM orders""",
)
def path_templates(spark, sf):
    template = F.lit("videos/{video_key}/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.mp4")
    filled = paths.fill_template(template, video_key=F.lit("top"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        paths.v2_data_path(filled, F.col("o_orderkey"), F.lit(1000)).alias("path"),
        paths.v3_data_path(F.col("o_custkey"), F.lit(7)).alias("v3"),
    )


@query(
    "s14_sidecar_atoms",
    """SELECT 'm-' || conv_id || '-' || turn AS dataset, conv_id AS episode_index, CAST(k AS INT) AS "order", role, text AS content,
  CASE WHEN turn % 2 = 0 THEN 'memory' END AS style, CAST(turn AS DOUBLE) AS "timestamp", CAST(NULL AS VARCHAR) AS camera, '[{"type":"function"}]' AS tool_calls
FROM conversations CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE turn % 5 <> 4""",
)
def sidecar_atoms(spark, sf):
    return sidecars.parse_atoms(sidecar_texts(spark, sf))


@query(
    "s15_sidecar_segments",
    """WITH c AS (SELECT *, 'c' || c_custkey AS dataset FROM customer)
SELECT dataset, CAST(7 AS BIGINT) AS episode_index, CAST(0 AS BIGINT) AS entry, 'last ' || c_name AS instruction, c_nationkey AS start FROM c
UNION ALL SELECT dataset, 8, 0, c_name, c_nationkey FROM c WHERE c_mktsegment <> 'BUILDING'""",
)
def sidecar_segments(spark, sf):
    # Line JSON and arrays with a repeated episode; one segment without a list of its own.
    c = table(spark, sf, "customer")

    def record(ep, text):
        s = F.struct(text.alias("instruction"), F.col("c_nationkey").alias("start_frame_index"))
        return F.struct(F.lit(ep).alias("episode_index"), F.array(s).alias("instruction_segments"))

    first, second = record(7, F.lit("first")), record(8, F.col("c_name"))
    third = record(7, F.concat(F.lit("last "), F.col("c_name")))
    lines = F.concat_ws("\n", F.to_json(first), F.lit(""), F.to_json(second), F.to_json(third))
    building = F.col("c_mktsegment") == "BUILDING"
    array = F.to_json(F.array(first, second, third))
    text = F.when(building, F.to_json(third)).when(F.col("c_mktsegment") == "MACHINERY", array).otherwise(lines)
    out = sidecars.parse_segments(c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("dataset"), text.alias("text")))
    return out.select(*KEYS, "entry", "instruction", F.col("start_frame_index").cast("int").alias("start"))


@query(
    "s16_sidecar_upsert",
    sql(
        EV,
        """SELECT episode_index, position, 'new' AS text FROM ev WHERE event_type = 'signup' AND n > 70 AND k > 50
UNION ALL SELECT episode_index, position, 'signup ' || CAST(k AS BIGINT) FROM ev WHERE event_type = 'signup'
  AND episode_index NOT IN (SELECT episode_index FROM ev WHERE event_type = 'signup' AND n > 70 AND k > 50)""",
    ),
)
def sidecar_upsert(spark, sf):
    old = event_segments(spark, sf)
    long = ev_frames(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 70")
    new = event_segments(spark, sf, 51).join(long.select(*KEYS), KEYS, "left_semi").withColumn("instruction", F.lit("new"))
    out = sidecars.upsert(old, new.drop("skill"))
    return out.select("episode_index", F.col("start_frame_index").alias("position"), F.col("instruction").alias("text"))


@query(
    "s17_labelled_frames",
    sql(
        VOCAB
        + """,
act AS (SELECT ev.episode_index, ev.position, ev.task_index, ev.value,
          last_value(sg.instruction IGNORE NULLS) OVER (PARTITION BY ev.episode_index ORDER BY ev.position ROWS UNBOUNDED PRECEDING) AS cur
        FROM ev LEFT JOIN sg ON sg.episode_index = ev.episode_index AND sg.st = ev.position),
hd AS (SELECT episode_index, arg_min(instruction, st) AS head FROM sg GROUP BY 1)""",
        """SELECT act.episode_index, position, value, CAST(coalesce(v.subtask_index, 0) AS BIGINT) AS subtask_index
FROM act LEFT JOIN hd USING (episode_index) LEFT JOIN tk USING (task_index) LEFT JOIN vc v ON v.text = coalesce(cur, head, task)""",
    ),
)
def labelled_frames(spark, sf):
    frames = ev_frames(spark, sf)
    labelled = segments.label_frames(frames, event_segments(spark, sf), event_tasks(spark), cut(vocab(spark, sf)))
    written = sinks.write_labelled(labelled, frames, fresh_path(spark))
    return written.select("episode_index", "position", F.col("action")[0].alias("value"), "subtask_index")


@query("s18_vocabulary_sink", sql(VOCAB, "SELECT 'events' AS dataset, text, CAST(subtask_index AS BIGINT) AS subtask_index FROM vc"))
def vocabulary_sink(spark, sf):
    path = fresh_path(spark)
    sinks.write_vocabulary(vocab(spark, sf), path)
    return spark.read.parquet(path).select("dataset", F.col("__index_level_0__").alias("text"), "subtask_index")


@query(
    "s19_csv_sink",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS segment,
  '["' || c_mktsegment || '",' || '"a,b"]' AS list FROM customer""",
)
def csv_sink(spark, sf):
    path = fresh_path(spark)
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"),
        F.array("c_mktsegment", F.lit("a,b")).alias("list"),
    )
    sinks.write_csv(c, path)
    back = spark.read.option("header", True).option("escape", '"').schema(
        "key string, name string, segment string, list string"
    ).csv(path)
    return back.select("key", "name", F.coalesce("segment", F.lit("")).alias("segment"), "list")


@query(
    "s21_progress",
    sql(
        EV + ", nn AS (SELECT episode_index, max(value) > 300 AS hot FROM ev GROUP BY 1)",
        """SELECT dataset, episode_index, position, CASE WHEN hot THEN 'progress_sparse' ELSE 'progress_extra' END AS series,
  CASE WHEN hot THEN value ELSE k END AS progress FROM ev JOIN nn USING (episode_index) WHERE NOT hot OR value > 300""",
    ),
)
def progress(spark, sf):
    # The sparse column is set on high values only, the dense one never.
    rows = ev_frames(spark, sf).select(
        *KEYS,
        F.col("position").alias("index"),
        F.when(F.col("action")[0] > 300, F.col("action")[0]).alias("progress_sparse"),
        F.lit(float("nan")).alias("progress_dense"),
        F.col("action")[1].alias("progress_extra"),
    )
    out = readers.pick_progress(rows)
    return out.select(*KEYS, F.col("order").cast("long").alias("position"), "series", "progress")


TAGS = """
t0 AS (SELECT 'c' || c_custkey AS dataset, '  ' || c_mktsegment || ' Part  ' || c_nationkey || ' ' AS raw, c_nationkey AS k, c_acctbal AS bal FROM customer),
t1 AS (SELECT dataset, lower(trim(raw)) AS t, k, bal FROM t0)"""


def tag_texts(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" Part  "), F.col("c_nationkey"), F.lit(" "))
    doc = F.struct(
        raw.alias("task"),
        F.repeat(F.lit("Long Scene "), 10).alias("scene"),
        F.array(F.lit("Cup "), raw, F.lit("cup"), F.lit("  ")).alias("objects"),
        F.lit("   ").alias("notes"),
    )
    text = F.when(F.col("c_acctbal") < 0, F.lit("not json")).otherwise(F.to_json(doc))
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("dataset"), "c_acctbal", text.alias("text"))


CLEAN = "regexp_replace(t, '\\s+', '_', 'g')"


@query(
    "f06_clean_tags",
    sql(
        TAGS,
        f"""SELECT dataset, CASE WHEN bal >= 0 THEN {CLEAN} END AS task, CASE WHEN bal >= 0 THEN rtrim(repeat('long_scene_', 10), '_') END AS scene,
  CASE WHEN bal >= 0 THEN 'cup,' || {CLEAN} ELSE '' END AS objects FROM t1""",
    ),
)
def clean_tags(spark, sf):
    out = sidecars.parse_tags(tag_texts(spark, sf))
    return out.select("dataset", "task", "scene", F.array_join("objects", ",").alias("objects"))


@query(
    "s22_tag_sidecar",
    sql(
        TAGS,
        f"""SELECT dataset, CASE WHEN k > 20 THEN 'new_tag' WHEN bal < 0 THEN NULL WHEN k > 2 THEN {CLEAN} END AS task,
  k > 20 AS updated FROM t1""",
    ),
)
def tag_sidecar(spark, sf):
    texts = tag_texts(spark, sf)
    number = F.regexp_extract("text", r"Part  (\d+)", 1)
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("dataset"), "c_nationkey")
    stored = sidecars.parse_tags(texts.join(c.where("c_nationkey > 2"), "dataset", "left_semi"))
    changes = c.where("c_nationkey > 20").select(
        "dataset",
        F.lit(" New Tag").alias("task"),
        F.lit(None).cast("string").alias("scene"),
        F.array().cast("array<string>").alias("objects"),
        F.lit(None).cast("string").alias("notes"),
    )
    updated = sidecars.update_tags(stored, changes, F.lit("2024-01-01T00:00:00Z"))
    return sidecars.tags_for(texts, updated).select("dataset", "task", F.col("updated_at").isNotNull().alias("updated"))


# ---- locating ------------------------------------------------------------------------


PLACES = LI + """,
gx AS (SELECT dataset, episode_index, position, q, row_number() OVER (PARTITION BY dataset ORDER BY episode_index, position) - 1 AS gi FROM li)"""


def recorded(spark, sf):
    """Frames with file and global index, and each episode's place; one dataset's are off."""
    f = li_frames(spark, sf).select(*KEYS, "position", F.col("action")[0].alias("q"))
    f = f.withColumn("_along", F.col("episode_index"))
    g = positions(f, ["episode_index", "position"], F.col("_along"), ["dataset"], "index").drop("_along")
    g = g.withColumn("data_file", F.floor(F.col("episode_index") / 10))
    frames = cut(g.withColumn("file", paths.v3_data_path(F.lit(0), F.col("data_file"))).drop("data_file"))
    stale = F.when(F.col("dataset") == "R", F.lit(1)).otherwise(F.lit(0))
    episodes = frames.groupBy(*KEYS).agg(F.min("index").alias("from_index"), (F.max("index") + 1).alias("to_index"))
    episodes = episodes.select(
        *KEYS,
        F.lit(0).alias("data_chunk"),
        (F.floor(F.col("episode_index") / 10) + stale).alias("data_file"),
        "from_index",
        F.when(F.col("dataset") == "A", F.col("to_index") - 5).otherwise(F.col("to_index")).alias("to_index"),
    )
    return frames, episodes


@query(
    "j01_rows_in_range",
    sql(
        PLACES + ", b AS (SELECT dataset, episode_index, max(gi) - 5 AS top FROM gx GROUP BY 1, 2)",
        """SELECT dataset, episode_index, count(*) AS frames, CAST(sum(gi) AS BIGINT) AS index_sum FROM gx JOIN b USING (dataset, episode_index)
WHERE dataset <> 'R' AND (dataset <> 'A' OR gi <= top) GROUP BY 1, 2""",
    ),
)
def rows_in_range(spark, sf):
    frames, episodes = recorded(spark, sf)
    rows = locate.rows_in_range(
        frames.withColumn("episode_index", F.when(F.col("dataset") != "N", F.col("episode_index"))), locate.locators(episodes)
    )
    return rows.groupBy(*KEYS).agg(F.count("*").alias("frames"), F.sum("index").alias("index_sum"))


@query(
    "j02_fallback_scan",
    sql(
        PLACES + ", b AS (SELECT dataset, episode_index, max(gi) - 5 AS top FROM gx GROUP BY 1, 2)",
        """SELECT dataset, episode_index, dataset = 'R' AS rescanned, count(*) AS frames FROM gx JOIN b USING (dataset, episode_index)
WHERE dataset <> 'A' OR gi <= top GROUP BY 1, 2, 3""",
    ),
)
def fallback_scan(spark, sf):
    frames, episodes = recorded(spark, sf)
    out = locate.load(frames, locate.locators(episodes))
    return out.groupBy(*KEYS, "rescanned").agg(F.count("*").alias("frames"))


# ---- series --------------------------------------------------------------------------


def li_names(spark):
    rows = [(d, "action", i, n) for d in "ANR" for i, n in enumerate(("price", "discount"))]
    rows += [(d, "observation.state", 0, "price") for d in "ANR"]
    return spark.createDataFrame(rows, "dataset string, feature string, dim int, name string")


def li_series(spark, sf):
    frames = li_frames(spark, sf).withColumn("late", F.col("position") > 100)
    return series.flatten(frames, ["action", "observation.state", "late"], li_names(spark))


SERIES = LI + """,
sr AS (SELECT dataset, episode_index, position, 'action' AS source, 'price' AS name, q AS value FROM li
  UNION ALL SELECT dataset, episode_index, position, 'action', 'discount', dc FROM li
  UNION ALL SELECT dataset, episode_index, position, 'observation.state', 'price', price FROM li
  UNION ALL SELECT dataset, episode_index, position, 'late', NULL, CASE WHEN position > 100 THEN 1 ELSE 0 END FROM li)"""


@query("p04_vector_flatten", sql(SERIES, "SELECT dataset, episode_index, position, source, name, CAST(value AS DOUBLE) AS value FROM sr"))
def vector_flatten(spark, sf):
    return li_series(spark, sf)


@query(
    "p01_column_projection",
    sql(LI, f"SELECT dataset, count(*) AS frames, {r('avg(q)')} AS mean FROM li GROUP BY 1"),
)
def column_projection(spark, sf):
    # Only the needed columns reach the scan.
    cols = li_frames(spark, sf).select("dataset", "action")
    out = cols.groupBy("dataset").agg(F.count("*").alias("frames"), F.avg(F.col("action")[0]).alias("mean"))
    return rounded(out, "mean")


@query(
    "p03_signal_columns",
    "SELECT unnest(['action', 'observation.state']) AS \"column\", (SELECT count(*) FROM lineitem) AS frames",
)
def signal_columns(spark, sf):
    from trajlake.checks.findings import Recording

    rec = Recording(frames=li_frames(spark, sf))
    out = None
    for c in rec.signal_columns():
        part = rec.frames.where(F.col(f"`{c}`").isNotNull()).agg(F.count("*").alias("frames")).select(F.lit(c).alias("column"), "frames")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p05_scalars_to_numbers",
    sql(LI, "SELECT dataset, CAST(sum(CASE WHEN position > 100 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS late FROM li GROUP BY 1"),
)
def scalars(spark, sf):
    frames = li_frames(spark, sf).withColumn("late", F.col("position") > 100)
    return frames.groupBy("dataset").agg(F.sum(series.number(frames, "late")).alias("late"))


@query(
    "p06_group_by_suffix",
    sql(
        SERIES,
        """SELECT dataset, episode_index, position, CASE WHEN count(*) > 1 THEN coalesce(name, min(source)) ELSE concat_ws(' | ', min(source), name) END AS key,
  count(*) > 1 AS grouped, CAST(count(*) AS INT) AS members, CAST(sum(value) AS DOUBLE) AS total FROM sr GROUP BY dataset, episode_index, position, name""",
    ),
)
def suffix_groups(spark, sf):
    out = series.group_by_suffix(li_series(spark, sf))
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x)
    return out.select(*KEYS, "position", "key", "grouped", F.size("values").alias("members"), total.alias("total"))


@query(
    "f18_series_names",
    sql(SERIES, "SELECT concat_ws(' | ', source, name) AS key, coalesce(name, source) AS suffix, coalesce(name, source) AS short, count(*) AS frames FROM sr GROUP BY 1, 2, 3"),
)
def series_names(spark, sf):
    key = series.series_key()
    return li_series(spark, sf).groupBy(
        key.alias("key"), series.suffix(key).alias("suffix"), series.short_name(key).alias("short")
    ).agg(F.count("*").alias("frames"))


@query(
    "a04_series_min_max",
    sql(
        SERIES,
        f"""SELECT dataset, concat_ws(' | ', source, name) AS series, {r('min(value)', 3)} AS minimum, {r('max(value)', 3)} AS maximum FROM sr GROUP BY 1, 2""",
    ),
)
def series_min_max(spark, sf):
    s = li_series(spark, sf).withColumn("series", series.series_key())
    return stats_ops.series_range(s)


@query(
    "a05_group_min_max",
    sql(SERIES, "SELECT dataset, episode_index, coalesce(name, source) AS suffix, CAST(min(value) AS DOUBLE) AS minimum, CAST(max(value) AS DOUBLE) AS maximum FROM sr GROUP BY 1, 2, 3"),
)
def group_min_max(spark, sf):
    s = li_series(spark, sf).withColumn("suffix", series.suffix(series.series_key()))
    return stats_ops.group_range(s, *KEYS, "suffix")


# ---- small functions -----------------------------------------------------------------


@query(
    "f01_lenient_numbers",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS number FROM orders""",
)
def lenient_numbers(spark, sf):
    text = (
        F.when(F.col("o_orderstatus") == "O", F.lit("NaN"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.col("o_totalprice").cast("string"), F.lit("d")))
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
    )
    return table(spark, sf, "orders").select("o_orderkey", number_or_null(text).alias("number"))


@query(
    "f02_vector_matrix",
    sql(
        LI + ", odd AS (SELECT dataset, episode_index, bool_or(q = 50 AND dc = 0.1) AS ragged FROM li GROUP BY 1, 2)",
        "SELECT dataset, episode_index, count(*) AS n, CAST(2 AS INT) AS width FROM li JOIN odd USING (dataset, episode_index) WHERE NOT ragged GROUP BY 1, 2",
    ),
)
def vector_matrix(spark, sf):
    # One ragged or null cell leaves the whole episode out.
    f = li_frames(spark, sf)
    q, d, t = (F.col("action")[i] for i in range(3))
    bad = (q == 50) & (d == 0.1)
    frames = f.withColumn("action", F.when(~bad, F.array(F.array(q), F.array(d))).otherwise(F.array(F.array(q, d), F.array(t))))
    return stats_ops.matrix(frames, "action")[1].select(*KEYS, "n", "width")


@query(
    "f03_cell_shapes",
    sql(LI, "SELECT dataset, CASE WHEN q > 25 THEN '[2,1]' ELSE '[1]' END AS shape, count(*) AS frames FROM li GROUP BY 1, 2"),
)
def cell_shapes(spark, sf):
    f = li_frames(spark, sf)
    q = F.col("action")[0]
    nested = f.withColumn("cell", F.array(F.array(q), F.array(q)))
    text = F.when(q > 25, vectors.shape(nested, "cell")).otherwise(vectors.shape(f, "observation.state"))
    return nested.groupBy("dataset", text.alias("shape")).agg(F.count("*").alias("frames"))

"""Trajectory views over the benchmark tables (events, lineitem, embeddings, …).

Each view is written once per application as a frame table, the form in which
recordings are stored, and read from there by the queries.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.paths import padded
from trajlake.operators.blocks import (
    KEYS,
    blocked,
    core,
    episode_lengths,
    positions,
    window,
)
from trajlake.operators.corpus import health, snapshot
from trajlake.session import cut_once

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} as timestamp_ntz))")


def ev_frames(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("ev_frames", sf, lambda: build_ev_frames(spark, sf))


def li_frames(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("li_frames", sf, lambda: build_li_frames(spark, sf))


def emb_frames(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("emb_frames", sf, lambda: build_emb_frames(spark, sf))


def build_ev_frames(spark: SparkSession, sf: str) -> DataFrame:
    """events as trajectories: one episode per user, a frame per event."""
    rows = table(spark, sf, "events").select(
        F.lit("events").alias("dataset"),
        F.col("user_id").alias("episode_index"),
        micros("ts").alias("_us"),
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("_k"),
    )
    numbered = positions(rows, ["_us", "event_id"], F.col("_us"))
    lengths = episode_lengths(numbered, F.min("_us").alias("_start"))
    frames = blocked(numbered, after=1, episodes=lengths)
    frames = frames.withColumn("_next", F.lead("value").over(window())).where(core())
    return frames.select(
        *KEYS,
        "position",
        F.col("position").alias("frame_index"),
        F.col("event_id").alias("index"),
        "event_type",
        F.expr(
            "case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 "
            "when 'signup' then 3 else 4 end"
        ).cast("long").alias("task_index"),
        ((F.col("_us") - F.col("_start")) / 1e6).alias("timestamp"),
        F.array("value", "_k").alias("action"),
        F.array(F.coalesce("_next", "value"), F.col("_k")).alias("observation.state"),
    )


LI_ORDER = [
    "_us",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
]


def build_li_frames(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as trajectories: a dataset per return flag, an episode per supplier."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_suppkey").alias("episode_index"),
        micros("l_shipdate").alias("_us"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
    )
    return positions(rows, LI_ORDER, F.col("_us")).select(
        *KEYS,
        "position",
        F.col("position").alias("frame_index"),
        F.col("l_orderkey").alias("index"),
        (F.col("position") / 10.0).alias("timestamp"),
        F.pmod("l_linenumber", F.lit(3)).cast("long").alias("task_index"),
        F.array("l_quantity", "l_discount", "l_tax").alias("action"),
        F.array("l_extendedprice").alias("observation.state"),
    )


def build_emb_frames(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as trajectories: an episode per label, 64-wide action vectors."""
    rows = table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("dataset"),
        F.col("label").cast("long").alias("episode_index"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("action"),
    )
    return positions(rows, ["vec_id"], F.col("vec_id")).select(
        *KEYS,
        "position",
        F.col("position").alias("frame_index"),
        F.col("vec_id").alias("index"),
        (F.col("position") / 10.0).alias("timestamp"),
        "action",
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("catalog", sf, lambda: build_catalog(spark, sf))


def build_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """customers as datasets: path region/nation/customer, sizes from their orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("_q"))
    per = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("total_episodes"),
            F.sum(F.coalesce("_q", F.lit(0.0))).cast("long").alias("total_frames"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("size_bytes"),
        )
    )
    where = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    c = (
        table(spark, sf, "customer")
        .join(where, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    zero = F.lit(0).cast("long")
    has_data = F.coalesce("total_frames", zero) > 0
    has_videos = F.col("c_acctbal") > 0
    return c.select(
        F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"),
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("robot_type"),
        F.coalesce("total_episodes", zero).alias("total_episodes"),
        F.coalesce("total_frames", zero).alias("total_frames"),
        F.when(F.col("c_acctbal") > 9000, F.lit(0.0)).otherwise(F.lit(30.0)).alias("fps"),
        F.coalesce("size_bytes", zero).alias("size_bytes"),
        has_data.alias("has_data"),
        has_videos.alias("has_videos"),
        health(F.col("total_episodes"), has_data, has_videos).alias("status"),
        F.when(F.col("c_acctbal") > 2000, F.lower("n_name")).alias("task"),
        F.lower("r_name").alias("scene"),
        F.array(F.concat(F.lit("obj_"), F.col("c_nationkey").cast("string"))).alias("objects"),
    )


def day_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """orders as a growth history: a row per order day and priority."""
    per = table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("prefix")
    ).agg(
        F.count_distinct("o_custkey").alias("tasks"),
        F.count("*").alias("episodes"),
        F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("frames"),
        F.when(F.min("o_orderstatus") != "F", F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))).alias("bytes"),
    )
    return snapshot(per.withColumn("hours", F.col("frames") / 30 / 3600), F.col("day"))


def pose_names(spark: SparkSession) -> DataFrame:
    """Names for the first ten embedding dims: a tool pose and a gripper."""
    parts = ["x", "y", "z", "r1", "r2", "r3", "r4", "r5", "r6"]
    rows = [("embeddings", "action", i, f"left_tcp.{p}") for i, p in enumerate(parts)]
    rows.append(("embeddings", "action", 9, "left_gripper.pos"))
    rows.append(("embeddings", "action", 10, "right_tcp.x"))
    return spark.createDataFrame(rows, "dataset string, feature string, dim int, name string")


# Atom style by turn, in this order.
STYLES = ("task_aug", "subtask", "plan", "memory", "interjection", "vqa")


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as language atoms: a conversation is an episode, a turn a second."""
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), F.pmod("turn", F.lit(6)).cast("int") + 1)
    return table(spark, sf, "conversations").select(
        F.lit("chats").alias("dataset"),
        F.col("conv_id").alias("episode_index"),
        "role",
        F.col("text").alias("content"),
        style.alias("style"),
        F.col("turn").cast("double").alias("timestamp"),
        F.when(F.pmod("turn", F.lit(4)) == 0, F.lit("top")).alias("camera"),
        F.lit(None).cast("string").alias("tool_calls"),
        F.col("turn").alias("order"),
    )


def event_segments(spark: SparkSession, sf: str, least_k: int = 0) -> DataFrame:
    """A segment starting at every signup event; ``least_k`` leaves episodes without any."""
    f = ev_frames(spark, sf).where(F.col("event_type") == "signup")
    k = F.col("action")[1].cast("long")
    return f.where(k >= least_k).select(
        *KEYS,
        F.lit("move").alias("skill"),
        F.concat(F.lit("signup "), k.cast("string")).alias("instruction"),
        F.col("position").alias("start_frame_index"),
        F.when(k % 2 == 0, F.col("position") + 2).alias("success_frame_index"),
        F.col("position").alias("end_frame_index"),
        F.col("position").alias("entry"),
    )


def last_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Last frame per episode, ten short of the data so that starts get clamped."""
    return ev_frames(spark, sf).groupBy(*KEYS).agg((F.count("*") - 10).alias("last_frame"))


def event_tasks(spark: SparkSession) -> DataFrame:
    rows = [("events", i, t) for i, t in enumerate(("click", "view", "purchase", "signup 50", "error"))]
    return spark.createDataFrame(rows, "dataset string, task_index long, task string")


def dirty_frames(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem trajectories with defects: clipped and spiking actions, stuck and drifting states."""
    f = li_frames(spark, sf)
    q, d = F.col("action")[0], F.col("action")[1]
    price = F.col("`observation.state`")[0]
    return f.select(
        *KEYS,
        "position",
        "frame_index",
        "timestamp",
        "task_index",
        F.array(F.floor(q / 30).cast("double")).alias("action"),
        F.array(F.when((q == 50) & (d == 0.1), F.lit(1000.0)).otherwise(q)).alias("action.spike"),
        F.array(
            price,
            F.lit(7.0),
            F.floor(F.col("position") / 40).cast("double"),
            F.col("episode_index") + price / 1e6,
        ).alias("observation.state"),
    )


def order_frames(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("order_frames", sf, lambda: build_order_frames(spark, sf))


def build_order_frames(spark: SparkSession, sf: str) -> DataFrame:
    """orders as episodes of their customer's dataset, a frame per line; some lack the state column."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = (
        table(spark, sf, "lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("dataset"),
            F.col("o_orderkey").alias("episode_index"),
            micros("l_shipdate").alias("_us"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
            "o_orderstatus",
        )
    )
    return positions(rows, LI_ORDER, F.col("_us")).select(
        *KEYS,
        "position",
        F.col("position").alias("frame_index"),
        (F.col("position") / 10.0).alias("timestamp"),
        F.pmod("l_linenumber", F.lit(3)).cast("long").alias("task_index"),
        F.array("l_quantity", "l_discount").alias("action"),
        F.when(F.col("o_orderstatus") != "P", F.array("l_extendedprice", "l_tax")).alias("observation.state"),
    )


def order_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return cut_once("order_lengths", sf, lambda: build_order_lengths(spark, sf))


def build_order_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The frame count ``n`` of every order with lines; no frame is numbered for it."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("_lines"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    per = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").cast("string").alias("dataset"), F.col("o_orderkey").alias("episode_index"), "o_orderpriority", "o_orderstatus"
    )
    return per.agg(F.sum("_lines").alias("n"))


def order_info_texts(spark: SparkSession, sf: str) -> DataFrame:
    """An info document per customer with orders, as JSON text; some are wrong on purpose."""
    per = order_lengths(spark, sf).groupBy("dataset").agg(F.count("*").alias("eps"), F.sum("n").alias("frames"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset"), "c_acctbal", "c_mktsegment")
    rows = per.join(c, "dataset")
    bal = F.col("c_acctbal")
    feature = "struct<dtype:string,shape:array<bigint>,names:array<string>>"

    def spec(dtype, shape, *names):
        listed = F.array(*[F.lit(n) for n in names]) if names else F.lit(None)
        return F.struct(
            F.lit(dtype).alias("dtype"), F.array(*[F.lit(s) for s in shape]).alias("shape"), listed.alias("names")
        ).cast(feature)

    features = F.map_from_entries(
        F.array_compact(
            F.array(
                F.struct(F.lit("action"), spec("float32", [2], "joint", "grip")),
                F.struct(F.lit("observation.state"), spec("float32", [2])),
                F.when(bal > 0, F.struct(F.lit("observation.images.top"), spec("video", [480, 640, 3]))),
                F.when(bal > 5000, F.struct(F.lit("observation.force"), spec("float32", [6]))),
            )
        )
    )
    document = F.struct(
        F.when(bal > 8000, F.lit("v1.9")).otherwise(F.lit("v3.0")).alias("codebase_version"),
        F.when(bal < -500, F.lit(0)).otherwise(F.lit(10)).alias("fps"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("eps") + F.when(bal < 0, 1).otherwise(0)).alias("total_episodes"),
        (F.col("frames") + F.when(bal > 9500, 1).otherwise(0)).alias("total_frames"),
        F.lit(3).alias("total_tasks"),
        features.alias("features"),
        F.when(bal > 9000, F.lit("/abs/data.parquet"))
        .otherwise(F.lit("data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet")).alias("data_path"),
        F.lit("videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4").alias("video_path"),
        F.lower("c_mktsegment").alias("robot_type"),
    )
    return rows.select("dataset", F.to_json(document).alias("text"))


def order_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episode metadata of the order datasets; the length is off for some."""
    wrong = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "O")
    return order_lengths(spark, sf).select(
        *KEYS, (F.col("n") + F.when(wrong, 1).otherwise(0)).alias("length"), "o_orderpriority", "o_orderstatus"
    )


def order_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the order datasets: data and episode metadata, and videos for most orders."""
    e = order_episodes(spark, sf)
    number = padded(F.col("episode_index"), 3)
    chunk = padded(F.floor(F.col("episode_index") / 1000), 3)
    size = F.col("length") * 1000
    data = e.select("dataset", F.concat(F.lit("data/chunk-000/file-"), number, F.lit(".parquet")).alias("path"), size.alias("size"))
    video = e.where("o_orderpriority != '5-LOW'").select(
        "dataset",
        F.concat(F.lit("videos/observation.images.top/chunk-"), chunk, F.lit("/file-"), number, F.lit(".mp4")).alias("path"),
        (size * 10).alias("size"),
    )
    meta = e.where("o_orderpriority = '1-URGENT'").select(
        "dataset", F.lit("meta/episodes/chunk-000/file-000.parquet").alias("path"), F.lit(100).cast("long").alias("size")
    ).distinct()
    out = data.unionByName(video).unionByName(meta)
    return out.withColumns({"readable": F.col("size") != 3000, "symlink": F.col("size") == 40000})


def sidecar_texts(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as annotation documents: one JSON text per message."""
    c = table(spark, sf, "conversations")
    atom = F.struct(
        F.when(F.col("turn") % 5 != 4, F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(F.col("turn") % 2 == 0, F.lit("memory")).alias("style"),
        F.col("turn").alias("timestamp"),
        F.lit("").alias("camera"),
        F.array(F.struct(F.lit("function").alias("type"))).alias("tool_calls"),
    )
    doc = F.struct(
        F.lit(1).alias("version"),
        F.create_map(F.col("conv_id").cast("string"), F.struct(F.array(atom, atom).alias("atoms"))).alias("episodes"),
    )
    return c.select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("dataset"), F.to_json(doc).alias("text"))

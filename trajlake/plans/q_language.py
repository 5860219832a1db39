"""Queries over language atoms, subtask segments and frame labels."""

from pyspark.sql import functions as F

from trajlake.functions import language as lang
from trajlake.functions.numbers import round_half_up
from trajlake.operators import annotations as ann
from trajlake.operators import segments as seg
from trajlake.operators.blocks import KEYS
from trajlake.plans.oracle import EV, r, sql
from trajlake.plans.q_stats import rounded
from trajlake.plans.registry import query
from trajlake.plans.views import (
    atoms,
    ev_frames,
    event_segments,
    event_tasks,
    last_frames,
    table,
)
from trajlake.session import cut

AT = """
atoms AS (SELECT 'chats' AS dataset, conv_id AS episode_index, role, text AS content,
  ['task_aug', 'subtask', 'plan', 'memory', 'interjection', 'vqa'][turn % 6 + 1] AS style, CAST(turn AS DOUBLE) AS timestamp,
  CASE WHEN turn % 4 = 0 THEN 'top' END AS camera, turn AS "order" FROM conversations)"""


@query(
    "f09_target_column",
    sql(
        AT,
        """SELECT style, CASE WHEN style IN ('interjection', 'vqa') THEN 'language_events' ELSE 'language_persistent' END AS target,
  count(*) AS atoms FROM atoms GROUP BY 1, 2""",
    ),
)
def target_column(spark, sf):
    return atoms(spark, sf).groupBy("style", lang.target_column(F.col("style")).alias("target")).agg(
        F.count("*").alias("atoms")
    )


@query(
    "f10_speech_text",
    """SELECT conv_id, turn, role = 'assistant' AND turn % 2 = 1 AND turn % 5 <> 1 AS speech,
  CASE WHEN role = 'assistant' AND turn % 2 = 1 AND turn % 5 <> 1 THEN text END AS said FROM conversations""",
)
def speech_text(spark, sf):
    # Every odd turn is a tool call that says the text; some call another tool.
    c = table(spark, sf, "conversations")
    tool = F.when(F.pmod("turn", F.lit(5)) == 1, F.lit("wave")).otherwise(F.lit("say"))
    call = F.array(
        F.struct(
            F.lit("function").alias("type"),
            F.struct(tool.alias("name"), F.struct("text").alias("arguments")).alias("function"),
        )
    )
    c = c.withColumn("calls", F.when(F.pmod("turn", F.lit(2)) == 1, F.to_json(call)))
    none = F.lit(None).cast("string")
    return c.select(
        "conv_id",
        "turn",
        lang.is_speech(none, F.col("role"), F.col("calls")).alias("speech"),
        lang.speech_text(none, F.col("role"), F.col("calls")).alias("said"),
    )


@query(
    "f11_vqa_kind",
    """SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'bbox' WHEN 1 THEN 'keypoint' WHEN 2 THEN 'count' WHEN 3 THEN 'attribute'
  WHEN 4 THEN 'spatial' END AS kind FROM conversations""",
)
def vqa_kind(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    label = F.expr("substring(label_json, 6, length(label_json) - 6)")
    c = c.withColumn("label_json", text)
    forms = {
        0: F.concat(F.lit('{"detections":[{"label":'), label, F.lit("}]}")),
        1: F.concat(F.lit('{"label":'), label, F.lit(',"point_format":"xy","point":[1,2]}')),
        2: F.concat(F.lit('{"label":'), label, F.lit(',"count":'), F.col("turn").cast("string"), F.lit("}")),
        3: F.concat(F.lit('{"label":"x","attribute":"colour","value":'), label, F.lit("}")),
        4: F.concat(F.lit('{"subject":"a","relation":"on","object":'), label, F.lit("}")),
        5: F.concat(F.lit('{"count":"three","label":'), label, F.lit("}")),
        6: F.concat(F.lit('{"attribute":"colour","value":null,"subject":'), label, F.lit("}")),
    }
    answer = F.col("text")
    for k, v in forms.items():
        answer = F.when(F.pmod("turn", F.lit(8)) == k, v).otherwise(answer)
    return c.select("conv_id", "turn", lang.vqa_kind(answer).alias("kind"))


def embedded(spark, sf):
    """Frames that carry atoms: every turn repeats the conversation's first atom and holds its own event."""
    a = atoms(spark, sf)
    atom = F.struct("role", "content", "style", "timestamp", "camera", "tool_calls")
    firsts = a.groupBy(*KEYS).agg(F.min_by(atom, "order").alias("_first"))
    rows = a.withColumn("position", F.col("order")).join(firsts, KEYS)
    late = F.struct(
        "role",
        "content",
        F.lit("interjection").alias("style"),
        F.lit(None).cast("double").alias("timestamp"),
        F.lit("").alias("camera"),
        "tool_calls",
    )
    return rows.select(
        *KEYS,
        "position",
        "timestamp",
        F.when(F.col("position") > 0, F.array("_first", "_first")).otherwise(
            F.array().cast("array<struct<role:string,content:string,style:string,timestamp:double,camera:string,tool_calls:string>>")
        ).alias("language_persistent"),
        F.array(late).alias("language_events"),
    )


@query(
    "f12_embedded_atoms",
    sql(
        AT,
        """SELECT dataset, episode_index, 'language_persistent' AS source, arg_min(role, "order") AS role, arg_min(content, "order") AS content,
  arg_min(style, "order") AS style, min("timestamp") AS "timestamp", arg_min(coalesce(camera, ''), "order") AS camera
FROM atoms GROUP BY 1, 2 HAVING count(*) > 1 OR min("order") > 0
UNION ALL SELECT dataset, episode_index, 'language_events', role, content, 'interjection', "timestamp", '' FROM atoms""",
    ),
)
def embedded_atoms(spark, sf):
    out = ann.embedded_atoms(embedded(spark, sf))
    return out.select(
        *KEYS, "source", "role", "content", "style", "timestamp", F.coalesce("camera", F.lit("")).alias("camera")
    )


@query(
    "f13_partition_atoms",
    sql(
        AT,
        """SELECT CASE WHEN style IN ('interjection', 'vqa') THEN 'events' ELSE 'persistent' END AS part, episode_index, "timestamp", style
FROM atoms""",
    ),
)
def partition_atoms(spark, sf):
    lasting, events = ann.partition_atoms(atoms(spark, sf))
    cols = ["episode_index", "timestamp", "style"]
    return lasting.select(F.lit("persistent").alias("part"), *cols).unionByName(
        events.select(F.lit("events").alias("part"), *cols)
    )


@query(
    "p14_camera_filter",
    sql(AT, """SELECT episode_index, "timestamp", camera FROM atoms WHERE camera IS NULL OR camera = 'wrist'"""),
)
def camera_filter(spark, sf):
    a = atoms(spark, sf)
    return a.where(lang.matches_camera(F.col("camera"), "wrist")).select("episode_index", "timestamp", "camera")


@query(
    "u05_distinct_atoms",
    sql(AT, "SELECT episode_index, style, role, count(DISTINCT content) AS atoms FROM atoms GROUP BY 1, 2, 3"),
)
def distinct_atoms(spark, sf):
    a = atoms(spark, sf).withColumn("timestamp", F.lit(0.0)).drop("camera").withColumn(
        "camera", F.lit(None).cast("string")
    )
    return ann.distinct_atoms(a.unionByName(a)).groupBy("episode_index", "style", "role").agg(
        F.count("*").alias("atoms")
    )


@query(
    "j17_annotation_precedence",
    sql(
        AT
        + """,
ses AS (SELECT * FROM atoms WHERE role = 'system'),
sid AS (SELECT * FROM atoms WHERE style = 'subtask' AND length(content) > 300)""",
        """SELECT 'session' AS layer, episode_index, content FROM ses
UNION ALL SELECT 'sidecar', episode_index, content FROM sid WHERE episode_index NOT IN (SELECT episode_index FROM ses)
UNION ALL SELECT 'embedded', episode_index, content FROM atoms WHERE episode_index NOT IN (SELECT episode_index FROM ses)
  AND episode_index NOT IN (SELECT episode_index FROM sid)""",
    ),
)
def annotation_precedence(spark, sf):
    a = atoms(spark, sf)
    session = a.where("role = 'system'").withColumn("layer", F.lit("session"))
    sidecar = a.where((F.col("style") == "subtask") & (F.length("content") > 300)).withColumn("layer", F.lit("sidecar"))
    out = ann.by_precedence(session, sidecar, a.withColumn("layer", F.lit("embedded")))
    return out.select("layer", "episode_index", "content")


@query(
    "w14_annotation_spans",
    sql(
        AT
        + """,
du AS (SELECT episode_index, max("timestamp") + 5 AS duration FROM atoms GROUP BY 1),
sp AS (SELECT *, lead("timestamp") OVER (PARTITION BY episode_index, style ORDER BY "timestamp") AS nx FROM atoms WHERE style IN ('subtask', 'plan'))""",
        """SELECT episode_index, "order", style AS lane, 'span' AS kind, "timestamp" AS start, coalesce(nx, duration) AS "end" FROM sp JOIN du USING (episode_index)
UNION ALL SELECT episode_index, "order", style, 'span', 0, duration FROM atoms JOIN du USING (episode_index) WHERE style = 'task_aug'
UNION ALL SELECT episode_index, "order", style, 'tick', "timestamp", "timestamp" FROM atoms
  WHERE style IN ('memory', 'interjection') OR (style = 'vqa' AND role = 'assistant')""",
    ),
)
def annotation_spans(spark, sf):
    a = atoms(spark, sf)
    durations = a.groupBy(*KEYS).agg((F.max("timestamp") + 5).alias("duration"))
    return ann.spans(a, durations).select("episode_index", "order", "lane", "kind", "start", "end")


@query(
    "j10_active_annotation",
    sql(
        EV,
        """SELECT dataset, episode_index, position,
  last_value(CASE WHEN event_type = 'signup' THEN CAST(CAST(k AS BIGINT) AS VARCHAR) END IGNORE NULLS)
    OVER (PARTITION BY episode_index ORDER BY position ROWS UNBOUNDED PRECEDING) AS active FROM ev""",
    ),
)
def active_annotation(spark, sf):
    frames = ev_frames(spark, sf)
    marks = frames.where(F.col("event_type") == "signup").select(
        *KEYS,
        "timestamp",
        F.lit("subtask").alias("style"),
        F.col("action")[1].cast("long").cast("string").alias("content"),
        F.col("position").alias("order"),
    )
    rows = frames.select(*KEYS, "position", "timestamp")
    return ann.active_atoms(rows, marks, "subtask", width=200_000.0).drop("timestamp")


@query(
    "j12_events_near",
    sql(
        EV,
        f"""SELECT a.episode_index, a.position AS probe, b.position AS event, {r('b.t - a.t')} AS gap
FROM ev a JOIN ev b ON a.episode_index = b.episode_index AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(a.t - b.t) <= 7200""",
    ),
)
def events_near(spark, sf):
    f = ev_frames(spark, sf)
    probes = f.where("event_type = 'purchase'").select(*KEYS, F.col("position").alias("probe"), F.col("timestamp").alias("at"))
    events = f.where("event_type = 'error'").select(*KEYS, F.col("position").alias("event"), "timestamp")
    out = ann.events_near(probes, events, window=7200.0)
    return out.select(
        "episode_index", "probe", "event", round_half_up(F.col("timestamp") - F.col("at"), 6).alias("gap")
    )


@query(
    "j13_snap_to_frame",
    sql(
        EV
        + """,
pt AS (SELECT episode_index, position, t + k * 500 AS tt FROM ev WHERE event_type = 'signup'),
nr AS (SELECT pt.episode_index, pt.position, ev.position AS fp, ev.t AS ft,
         row_number() OVER (PARTITION BY pt.episode_index, pt.position ORDER BY abs(ev.t - tt), ev.position) AS rk
       FROM pt JOIN ev USING (episode_index))""",
        f"SELECT episode_index, position AS point, fp AS frame_position, {r('ft')} AS frame_time FROM nr WHERE rk = 1",
    ),
)
def snap_to_frame(spark, sf):
    f = ev_frames(spark, sf)
    points = f.where("event_type = 'signup'").select(
        *KEYS, F.col("position").alias("point"), (F.col("timestamp") + F.col("action")[1] * 500).alias("timestamp")
    )
    out = ann.snap_to_frames(points, f.select(*KEYS, "position", "timestamp"), width=200_000.0)
    return rounded(out.select("episode_index", "point", "frame_position", "frame_time"), "frame_time")


@query(
    "f14_frame_and_time",
    sql(
        EV,
        f"""SELECT dataset, episode_index, position, CAST(greatest(0, floor(value * 30 + 0.5)) AS BIGINT) AS frame, {r('position / 30.0')} AS seconds FROM ev""",
    ),
)
def frame_and_time(spark, sf):
    fps = F.lit(30.0)
    return ev_frames(spark, sf).select(
        *KEYS,
        "position",
        ann.time_to_frame(F.col("action")[0], fps).alias("frame"),
        round_half_up(ann.frame_to_time(F.col("position"), fps), 6).alias("seconds"),
    )


TASKS = "tk AS (SELECT unnest([0, 1, 2, 3, 4]) AS task_index, unnest(['click', 'view', 'purchase', 'signup 50', 'error']) AS task)"


@query(
    "j03_task_text",
    sql(EV + ",\n" + TASKS, "SELECT dataset, episode_index, task, count(*) AS frames FROM ev LEFT JOIN tk USING (task_index) GROUP BY 1, 2, 3"),
)
def task_text(spark, sf):
    out = ann.with_task_text(ev_frames(spark, sf).drop("action", "observation.state"), event_tasks(spark))
    return out.groupBy(*KEYS, "task").agg(F.count("*").alias("frames"))


@query(
    "j04_task_resolution",
    sql(
        EV
        + ",\n"
        + TASKS
        + """,
said AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'buy ' || CAST(k AS BIGINT) || CASE WHEN k > 50 THEN chr(10) || 'much' ELSE '' END END AS txt FROM ev),
pk AS (SELECT episode_index, max(n) AS n, max(CASE WHEN position = 0 THEN txt END) AS a, max(CASE WHEN position = n // 2 THEN txt END) AS b,
         max(CASE WHEN position = n - 1 THEN txt END) AS c, max(CASE WHEN position = 0 THEN task_index END) AS ti FROM said GROUP BY 1)""",
        """SELECT 'events' AS dataset, episode_index, coalesce(CASE WHEN n > 72 THEN 'one' || chr(10) || 'two' END, a, b, c, task) AS task
FROM pk LEFT JOIN tk ON tk.task_index = ti""",
    ),
)
def task_resolution(spark, sf):
    f = ev_frames(spark, sf)
    k = F.col("action")[1].cast("long")
    bought = F.col("event_type") == "purchase"
    frames = f.select(
        *KEYS,
        "position",
        "task_index",
        F.when(bought, F.concat(F.lit("buy "), k.cast("string"))).alias("language_instruction"),
        F.when(bought & (k > 50), F.lit("much")).alias("language_instruction_2"),
    )
    episodes = f.groupBy(*KEYS).agg(F.count("*").alias("n"))
    episodes = episodes.select(*KEYS, F.when(F.col("n") > 72, F.array(F.lit("one"), F.lit("two"))).alias("tasks"))
    return ann.episode_task(frames, episodes, event_tasks(spark))


SG = """,
sg AS (SELECT dataset, episode_index, position AS st, 'signup ' || CAST(k AS BIGINT) AS instruction,
         CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN position + 2 END AS ok, k, n - 10 AS cap FROM ev WHERE event_type = 'signup')"""


def normalised(source: str, name: str) -> str:
    """SQL for contiguous segments of ``source(dataset, episode_index, st, e, instruction, ok, cap)``."""
    return f""",
{name}0 AS (SELECT *, least(greatest(0, cap), greatest(0, st)) AS c FROM {source}),
{name}1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, c ORDER BY st DESC, e DESC) AS rk FROM {name}0) WHERE rk = 1),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY c) - 1 AS segment_id,
          lead(c) OVER (PARTITION BY episode_index ORDER BY c) AS nx FROM {name}1),
{name} AS (SELECT dataset, episode_index, segment_id, CASE WHEN segment_id = 0 THEN 0 ELSE c END AS start_frame_index,
         greatest(CASE WHEN segment_id = 0 THEN 0 ELSE c END, coalesce(nx, greatest(0, cap))) AS end_frame_index, instruction, ok, cap FROM {name}2)"""


NORM_OUT = """SELECT dataset, episode_index, segment_id, start_frame_index, end_frame_index,
  CASE WHEN ok >= start_frame_index AND ok <= end_frame_index THEN ok END AS success_frame_index, instruction FROM {}"""
NORM_COLS = [
    *KEYS, "segment_id", "start_frame_index", "end_frame_index", "success_frame_index", "instruction",
]


@query(
    "w13_segment_contiguity",
    sql(EV + SG + ", sge AS (SELECT *, st AS e FROM sg)" + normalised("sge", "nm"), NORM_OUT.format("nm")),
)
def segment_contiguity(spark, sf):
    return seg.normalise(event_segments(spark, sf), last_frames(spark, sf)).select(*NORM_COLS)


@query(
    "f15_segment_coerce",
    sql(
        EV + SG,
        """SELECT dataset, episode_index, trim(CASE WHEN k < 10 THEN '  ' ELSE instruction || ' ' END) AS instruction, greatest(0, st - 5) AS start_frame_index,
  CASE WHEN ok IS NOT NULL THEN greatest(0, ok - 10) END AS success_frame_index, greatest(greatest(0, st - 5), st - 7) AS end_frame_index
FROM sg WHERE k >= 10""",
    ),
)
def segment_coerce(spark, sf):
    s = event_segments(spark, sf)
    k = F.split("instruction", " ")[1].cast("long")
    raw = s.select(
        *KEYS,
        "skill",
        F.when(k < 10, F.lit("  ")).otherwise(F.concat("instruction", F.lit(" "))).alias("instruction"),
        (F.col("start_frame_index") - 5).cast("string").alias("start_frame_index"),
        (F.col("success_frame_index") - 10).alias("success_frame_index"),
        (F.col("end_frame_index") - 7).alias("end_frame_index"),
    )
    return seg.coerce(raw).select(*KEYS, "instruction", "start_frame_index", "success_frame_index", "end_frame_index")


EDITS = (
    EV
    + SG
    + ", sge AS (SELECT *, st AS e FROM sg)"
    + normalised("sge", "nm")
    + """,
ins0 AS (SELECT dataset, episode_index, least(greatest(0, max(cap)), 7) AS st FROM sg GROUP BY 1, 2),
insx AS (SELECT nm.dataset, nm.episode_index, start_frame_index AS st, segment_id AS e, instruction, ok, cap FROM nm
         LEFT JOIN ins0 i ON i.episode_index = nm.episode_index AND i.st = start_frame_index WHERE i.st IS NULL
         UNION ALL SELECT i.dataset, i.episode_index, i.st, 4611686018427387904, 'inserted', NULL, (SELECT max(cap) FROM sg WHERE sg.episode_index = i.episode_index)
         FROM ins0 i),
rmx AS (SELECT dataset, episode_index, start_frame_index AS st, segment_id AS e, instruction, ok, cap FROM nm WHERE segment_id <> 1),
rt0 AS (SELECT *, lag(start_frame_index) OVER w AS pv, lead(start_frame_index) OVER w AS nx FROM nm WINDOW w AS (PARTITION BY episode_index ORDER BY segment_id)),
rtx AS (SELECT dataset, episode_index, CASE WHEN segment_id = 2 THEN least(greatest(12, pv + 1), greatest(pv + 1, coalesce(nx - 1, greatest(0, cap))))
          ELSE start_frame_index END AS st, segment_id AS e, instruction, ok, cap FROM rt0),
upx AS (SELECT dataset, episode_index, start_frame_index AS st, segment_id AS e, CASE WHEN segment_id = 0 THEN 'first' ELSE instruction END AS instruction, ok, cap FROM nm)"""
    + normalised("insx", "ni")
    + normalised("rmx", "nr")
    + normalised("rtx", "nt")
    + normalised("upx", "nu")
)


@query(
    "f16_segment_edits",
    sql(
        EDITS,
        " UNION ALL ".join(
            f"SELECT '{name}' AS edit, dataset, episode_index, segment_id, start_frame_index, end_frame_index, instruction FROM {cte}"
            for name, cte in (("insert", "ni"), ("remove", "nr"), ("retime", "nt"), ("update", "nu"))
        ),
    ),
)
def segment_edits(spark, sf):
    last = cut(last_frames(spark, sf))
    base = cut(
        seg.normalise(event_segments(spark, sf), last).withColumn("entry", F.col("segment_id"))
    )
    each = base.select(*KEYS).distinct()
    none = F.lit(None).cast("long")
    edits = {
        "insert": seg.insert(
            base,
            each.select(
                *KEYS,
                F.lit(7).cast("long").alias("start_frame_index"),
                F.lit(" inserted ").alias("instruction"),
                F.lit("").alias("skill"),
                none.alias("success_frame_index"),
            ),
            last,
        ),
        "remove": seg.remove(base, each.withColumn("segment_id", F.lit(1).cast("long")), last),
        "retime": seg.retime(
            base,
            each.select(*KEYS, F.lit(2).cast("long").alias("segment_id"), F.lit(12).cast("long").alias("new_start")),
            last,
        ),
        "update": seg.update_text(
            base, each.select(*KEYS, F.lit(0).cast("long").alias("segment_id"), F.lit("first").alias("instruction")), last
        ),
    }
    out = None
    for name, df in edits.items():
        part = df.select(
            F.lit(name).alias("edit"), *KEYS, "segment_id", "start_frame_index", "end_frame_index", "instruction"
        )
        out = part if out is None else out.unionByName(part)
    return out


VOCAB = (
    EV
    + SG
    + ",\n"
    + TASKS
    + """,
old AS (SELECT unnest(['error', 'signup 98']) AS text, unnest([0, 1]) AS subtask_index),
al AS (SELECT task AS text, 0 AS a, task_index AS b, 0 AS c FROM tk UNION ALL SELECT instruction, 1, episode_index, st FROM sg),
fs AS (SELECT text, min((a, b, c)) AS o FROM al WHERE text NOT IN (SELECT text FROM old) GROUP BY 1),
vc AS (SELECT text, subtask_index FROM old UNION ALL SELECT text, 1 + row_number() OVER (ORDER BY o) FROM fs)"""
)


def vocab(spark, sf):
    old = spark.createDataFrame(
        [("events", "error", 0), ("events", "signup 98", 1)], "dataset string, text string, subtask_index long"
    )
    return seg.vocabulary(old, event_tasks(spark), event_segments(spark, sf))


@query("u04_vocabulary", sql(VOCAB, "SELECT 'events' AS dataset, text, CAST(subtask_index AS BIGINT) AS subtask_index FROM vc"))
def vocabulary(spark, sf):
    return vocab(spark, sf)


@query(
    "j11_frame_labels",
    sql(
        VOCAB
        + """,
act AS (SELECT ev.episode_index, ev.position, ev.task_index,
          last_value(sg.instruction IGNORE NULLS) OVER (PARTITION BY ev.episode_index ORDER BY ev.position ROWS UNBOUNDED PRECEDING) AS cur
        FROM ev LEFT JOIN sg ON sg.episode_index = ev.episode_index AND sg.st = ev.position),
hd AS (SELECT episode_index, arg_min(instruction, st) AS head FROM sg GROUP BY 1)""",
        """SELECT 'events' AS dataset, act.episode_index, position, CAST(coalesce(v.subtask_index, 0) AS BIGINT) AS subtask_index
FROM act LEFT JOIN hd USING (episode_index) LEFT JOIN tk USING (task_index) LEFT JOIN vc v ON v.text = coalesce(cur, head, task)""",
    ),
)
def frame_labels(spark, sf):
    frames = ev_frames(spark, sf).select(*KEYS, "position", "frame_index", "task_index")
    out = seg.label_frames(frames, event_segments(spark, sf), event_tasks(spark), cut(vocab(spark, sf)))
    return out.select(*KEYS, "position", "subtask_index")

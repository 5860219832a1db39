"""Queries over the data-quality checks and the joins they are made of."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.checks import data, files, report
from trajlake.checks.findings import (
    Recording,
    affected_episodes,
    check_summary,
    severity_counts,
)
from trajlake.functions.numbers import round_half_up
from trajlake.operators import duplicates as dup
from trajlake.operators.blocks import KEYS
from trajlake.plans.oracle import DIRTY, EV, LI_LONG, ORD, r, sql
from trajlake.plans.q_motion import EVENTS
from trajlake.plans.registry import query
from trajlake.plans.views import (
    dirty_frames,
    emb_frames,
    ev_frames,
    li_frames,
    order_episodes,
    order_frames,
    order_info_texts,
    order_inventory,
    pose_names,
)
from trajlake.session import cut, cut_once
from trajlake.sources.readers import features_of, parse_infos


def typed(found: DataFrame) -> DataFrame:
    """Findings without their text, values rounded; PASS rows left out."""
    return found.where("severity != 'PASS'").select(
        "dataset", "severity", "episode_index", "column", "dim", "metric", round_half_up(F.col("value"), 6).alias("value")
    )


def li_infos(spark, fps=10.0):
    return spark.createDataFrame([(d, fps) for d in "ANR"], "dataset string, fps double")


def dirty(spark, sf) -> Recording:
    return Recording(frames=cut_once("dirty_frames", sf, lambda: dirty_frames(spark, sf)), infos=li_infos(spark))


def order_infos(spark, sf) -> DataFrame:
    return cut_once("order_infos", sf, lambda: parse_infos(order_info_texts(spark, sf)))


def order_recording(spark, sf, frames=True, inventory=True) -> Recording:
    """The order datasets; without ``frames`` or ``inventory`` for checks that read none of them."""
    infos = order_infos(spark, sf)
    return Recording(
        frames=order_frames(spark, sf) if frames else None,
        infos=infos,
        features=features_of(infos),
        episodes=order_episodes(spark, sf),
        inventory=cut_once("order_inventory", sf, lambda: order_inventory(spark, sf)) if inventory else None,
    )


def rows(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


def f(metric, value, source, severity="WARN", episode="episode_index", column="NULL::VARCHAR", dim="NULL::INT") -> str:
    """One SELECT of a findings oracle."""
    return (
        f"SELECT dataset, '{severity}' AS severity, CAST({episode} AS BIGINT) AS episode_index, {column} AS \"column\", "
        f"CAST({dim} AS INT) AS dim, '{metric}' AS metric, {r(f'CAST({value} AS DOUBLE)')} AS value FROM {source}"
    )


NONE = "NULL"

CLOCK = """,
cd AS (SELECT *, t - lag(t) OVER (PARTITION BY episode_index ORDER BY position) AS dt FROM ev),
ck AS (SELECT dataset, episode_index, count(*) FILTER (dt <= 0) AS nm, count(*) FILTER (dt > 1.5 * 39600) AS gaps,
         count(*) FILTER (dt > 2.5 * 39600) AS gaps2, avg(dt) FILTER (dt > 0) AS mi, count(*) + 1 AS n FROM cd WHERE dt IS NOT NULL GROUP BY 1, 2),
gi AS (SELECT dataset, event_id, lag(event_id) OVER (ORDER BY episode_index, position) AS p FROM ev),
gb AS (SELECT dataset, count(*) FILTER (p IS NOT NULL AND event_id <> p + 1) AS breaks FROM gi GROUP BY 1)"""


@query(
    "d02_temporal",
    sql(
        EV + CLOCK,
        rows(
            f("non_monotonic", "nm", "ck WHERE nm > 0"),
            f("gaps", "gaps", "ck WHERE gaps > 0"),
            f("mean_interval", "mi", "ck WHERE abs(mi - 39600) > 3960"),
            f("global_index", "breaks", "gb WHERE breaks > 0", episode=NONE),
        ),
    ),
)
def temporal(spark, sf):
    infos = spark.createDataFrame([("events", 1.0 / 39600)], "dataset string, fps double")
    return typed(data.temporal(Recording(frames=ev_frames(spark, sf), infos=infos)))


COARSE = DIRTY + """,
co AS (SELECT dataset, episode_index, position, n, floor(q / 30) AS c FROM li),
cr AS (SELECT dataset, count(*) FILTER (c = lo) / count(*) AS mn, count(*) FILTER (c = hi) / count(*) AS mx
       FROM (SELECT *, min(c) OVER (PARTITION BY dataset) AS lo, max(c) OVER (PARTITION BY dataset) AS hi FROM co) GROUP BY 1),
ch AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS chg FROM co WINDOW w AS (PARTITION BY dataset, episode_index ORDER BY position)),
ig AS (SELECT *, sum(chg) OVER (PARTITION BY dataset, episode_index ORDER BY position) AS isl FROM ch),
fr AS (SELECT dataset, episode_index, max(len) / max(n) AS share FROM
        (SELECT dataset, episode_index, max(n) AS n, count(*) - 1 AS len FROM ig GROUP BY dataset, episode_index, isl) GROUP BY 1, 2),
sch AS (SELECT *, CASE WHEN lag(x) OVER w = x THEN 0 ELSE 1 END AS chg FROM lil WINDOW w AS (PARTITION BY dataset, episode_index ORDER BY position)),
sig AS (SELECT *, sum(chg) OVER (PARTITION BY dataset, episode_index ORDER BY position) AS isl FROM sch),
sfr AS (SELECT dataset, episode_index, max(len) / max(n) AS share FROM
        (SELECT dataset, episode_index, max(n) AS n, count(*) - 1 AS len FROM sig GROUP BY dataset, episode_index, isl) GROUP BY 1, 2),
jp AS (SELECT dataset, episode_index, count(*) AS jumps FROM liz WHERE z > 8 AND n >= 3 GROUP BY 1, 2)"""

ACTIONS = rows(
    f("min_share", "mn", "cr WHERE mn > 0.5", episode=NONE, column="'action'", dim="0"),
    f("max_share", "mx", "cr WHERE mx > 0.5", episode=NONE, column="'action'", dim="0"),
    f("frozen_share", "share", "fr WHERE share >= 0.05", column="'action'"),
    f("frozen_share", "share", "sfr WHERE share >= 0.05", column="'action.spike'"),
    f("jumps", "jumps", "jp", column="'action.spike'"),
)


@query("d03_actions", sql(COARSE, ACTIONS))
def actions(spark, sf):
    return typed(data.actions(dirty(spark, sf)))


@query(
    "d13_per_episode",
    sql(
        COARSE,
        rows(
            f("frozen_share", "share", "fr WHERE share >= 0.05", column="'action'"),
            f("frozen_share", "share", "sfr WHERE share >= 0.05", column="'action.spike'"),
            f("jumps", "jumps", "jp", column="'action.spike'"),
        ),
    ),
)
def per_episode(spark, sf):
    return typed(data.per_episode(dirty(spark, sf)))


@query(
    "d05_speed_limits",
    sql(
        EVENTS + ", rk AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY score DESC, position) AS rank FROM hit)",
        f("speed", "score", "rk WHERE rank <= 5", column="'action'"),
    ),
)
def speed_limits(spark, sf):
    infos = spark.createDataFrame([("embeddings", 10.0)], "dataset string, fps double")
    rec = Recording(frames=emb_frames(spark, sf), infos=infos, names=pose_names(spark))
    return typed(data.speed_limits(rec))


STATE = DIRTY + """,
sx AS (SELECT dataset, episode_index, position, n, 'action' AS col, 0 AS dim, floor(q / 30) AS x FROM li
       UNION ALL SELECT dataset, episode_index, position, n, 'action.spike', 0, x FROM lil
       UNION ALL SELECT dataset, episode_index, position, n, 'observation.state', 0, price FROM li
       UNION ALL SELECT dataset, episode_index, position, n, 'observation.state', 1, 7 FROM li
       UNION ALL SELECT dataset, episode_index, position, n, 'observation.state', 2, position // 40 FROM li
       UNION ALL SELECT dataset, episode_index, position, n, 'observation.state', 3, episode_index + price / 1e6 FROM li),
mo AS (SELECT dataset, col, dim, avg(x) AS mu, CASE WHEN min(x) = max(x) THEN 0 ELSE stddev_pop(x) END AS sd, min(x) AS lo FROM sx GROUP BY 1, 2, 3),
ol AS (SELECT dataset, col, dim, count(*) AS c FROM sx JOIN mo USING (dataset, col, dim) WHERE sd > 0 AND abs((x - mu) / sd) > 10 GROUP BY 1, 2, 3)"""


@query(
    "d04_dimension_jumps",
    sql(
        STATE
        + """,
dj AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY dataset, col, dim, episode_index ORDER BY position)) AS d,
         x - lag(x) OVER (PARTITION BY dataset, col, dim, episode_index ORDER BY position) AS sg FROM sx),
dc AS (SELECT dataset, col, dim, CASE WHEN min(sg) = max(sg) THEN 1.0 ELSE coalesce(nullif(stddev_pop(sg), 0), 1.0) END AS scale
       FROM dj WHERE sg IS NOT NULL GROUP BY 1, 2, 3),
dz AS (SELECT dataset, col, episode_index, position, max(d / scale) AS z, count(*) FILTER (d / scale > 10) AS over10
       FROM dj JOIN dc USING (dataset, col, dim) WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, col, episode_index ORDER BY z DESC, position) AS rank FROM dz WHERE z > 12 OR over10 >= 2)""",
        f("max_z", "z", "rk WHERE rank <= 5", column="col"),
    ),
)
def dimension_jumps(spark, sf):
    return typed(data.dimension_jumps(dirty(spark, sf), threshold=10, extreme=12))


@query(
    "d07_statistics",
    sql(
        STATE,
        rows(
            f("zero_variance", "lo", "mo WHERE sd = 0", episode=NONE, column="col", dim="dim"),
            f("outliers", "c", "ol", episode=NONE, column="col", dim="dim"),
            f("not_in_stats", NONE, "(SELECT DISTINCT dataset FROM li)", episode=NONE, column="'action.spike'"),
        ),
    ),
)
def statistics(spark, sf):
    rec = dirty(spark, sf)
    stored = [(d, c, "mean", 0, 0.0) for d in "ANR" for c in ("action", "observation.state")]
    rec.stored_stats = spark.createDataFrame(stored, "dataset string, feature string, field string, dim int, value double")
    return typed(data.statistics(rec))


@query(
    "d11_anomalies",
    sql(
        STATE
        + """,
sl AS (SELECT *, lag(x) OVER (PARTITION BY dataset, col, dim, episode_index ORDER BY position) AS p FROM sx),
se AS (SELECT dataset, col, dim, episode_index, count(*) FILTER (x = p) / (max(n) - 1) AS share FROM sl GROUP BY 1, 2, 3, 4
       HAVING min(x) <> max(x) AND max(n) - 1 > 10),
sk AS (SELECT dataset, col, dim, count(*) AS c FROM se WHERE share > 0.8 GROUP BY 1, 2, 3),
ec AS (SELECT dataset, count(DISTINCT episode_index) AS m FROM li GROUP BY 1),
er AS (SELECT dataset, episode_index, row_number() OVER (PARTITION BY dataset ORDER BY episode_index) - 1 AS rk FROM (SELECT DISTINCT dataset, episode_index FROM li)),
sd AS (SELECT dataset, episode_index, CASE WHEN rk < m // 4 THEN 0 WHEN rk >= m - m // 4 THEN 1 END AS part FROM er JOIN ec USING (dataset) WHERE m >= 10),
sm AS (SELECT dataset, col, dim, part, avg(x) AS mu, CASE WHEN min(x) = max(x) THEN 1 ELSE stddev_pop(x) END AS s
       FROM sx JOIN sd USING (dataset, episode_index) WHERE part IS NOT NULL GROUP BY 1, 2, 3, 4),
sh AS (SELECT a.dataset, a.col, a.dim, abs(b.mu - a.mu) / a.s AS shift FROM sm a JOIN sm b USING (dataset, col, dim) WHERE a.part = 0 AND b.part = 1),
sb AS (SELECT dataset, col, arg_max(dim, shift) AS dim, max(shift) AS shift FROM sh GROUP BY 1, 2 HAVING max(shift) > 3)""",
        rows(
            f("stuck", "c", "sk JOIN ec USING (dataset) WHERE c > m * 0.8", episode=NONE, column="col", dim="dim"),
            f("shift", "shift", "sb", episode=NONE, column="col", dim="dim"),
            f("constant", "lo", "mo WHERE sd = 0", episode=NONE, column="col", dim="dim"),
        ),
    ),
)
def anomalies(spark, sf):
    return typed(data.anomalies(dirty(spark, sf)))


def with_copies(spark, sf):
    """Every episode three times: itself, an exact copy, and a copy off by 4e-7."""
    frames = li_frames(spark, sf).select(*KEYS, "position", "action")
    exact = frames.withColumn("episode_index", F.col("episode_index") + 10_000_000)
    near = frames.withColumn("episode_index", F.col("episode_index") + 20_000_000).withColumn(
        "action", F.transform("action", lambda x: x + 4e-7)
    )
    return frames.unionByName(exact).unionByName(near)


COPIES = LI_LONG + """,
b AS (SELECT dataset, episode_index + k AS ep, n, position * 3 + dim AS r, position, x + CASE WHEN k = 20000000 THEN 4e-7 ELSE 0 END AS x
      FROM lil, (SELECT unnest([0, 10000000, 20000000]) AS k)),
fp AS (SELECT dataset, ep, max(n) AS n, list_concat(list(x ORDER BY r) FILTER (position < 10 AND r < 20),
         (list(x ORDER BY r) FILTER (position >= n - 10))[1:20]) AS p FROM b GROUP BY 1, 2),
pr AS (SELECT a.dataset, a.ep AS l, c.ep AS rr FROM fp a JOIN fp c ON a.dataset = c.dataset AND a.n = c.n AND a.ep < c.ep
       WHERE list_max(list_transform(list_zip(a.p, c.p), lambda z: abs(z[1] - z[2]))) <= 1e-6)"""


@query("j15_near_duplicates", sql(COPIES, "SELECT dataset, count(*) AS pairs FROM pr GROUP BY 1"))
def near_duplicates(spark, sf):
    groups = cut(dup.identical_groups(dup.fingerprints(with_copies(spark, sf), "action")))
    return dup.pair_counts(groups, dup.near_pairs(groups))


@query(
    "j15_duplicate_pairs",
    sql(
        COPIES + ", g AS (SELECT dataset, n, p, min(ep) AS fe, count(*) AS c FROM fp GROUP BY 1, 2, 3)",
        """SELECT a.dataset, a.n, a.fe AS left_episode, b.fe AS right_episode, a.c * b.c AS pairs FROM g a JOIN g b
ON a.dataset = b.dataset AND a.n = b.n AND a.fe < b.fe WHERE list_max(list_transform(list_zip(a.p, b.p), lambda z: abs(z[1] - z[2]))) <= 1e-6""",
    ),
)
def duplicate_pairs(spark, sf):
    groups = cut(dup.identical_groups(dup.fingerprints(with_copies(spark, sf), "action")))
    return dup.near_pairs(groups)


@query(
    "j15_exact_copies",
    sql(
        COPIES,
        """SELECT dataset, ep AS episode_index, first_episode, copies FROM (SELECT dataset, ep, min(ep) OVER w AS first_episode, count(*) OVER w AS copies
FROM fp WINDOW w AS (PARTITION BY dataset, n, p)) WHERE copies > 1""",
    ),
)
def exact_copies(spark, sf):
    return dup.members(dup.fingerprints(with_copies(spark, sf), "action"))


@query(
    "j15_nearest_matches",
    sql(
        COPIES
        + """, we AS (SELECT dataset, ep, max(n) AS n, list(x ORDER BY r) AS p FROM b GROUP BY 1, 2),
wp AS (SELECT c.dataset, c.ep, c.n, a.ep AS l, a.p = c.p AS same FROM we a JOIN we c ON a.dataset = c.dataset AND a.n = c.n AND a.ep < c.ep
       WHERE list_max(list_transform(list_zip(a.p, c.p), lambda z: abs(z[1] - z[2]))) <= 1e-6)""",
        "SELECT dataset, ep AS episode_index, n, max(l) AS match, arg_max(same, l) AS exact FROM wp GROUP BY 1, 2, 3",
    ),
)
def nearest_matches(spark, sf):
    return dup.nearest_matches(with_copies(spark, sf), "action")


@query("j05_length_mismatch", sql(ORD, "SELECT dataset, episode_index, n, length FROM oe WHERE n <> length"))
def length_mismatch(spark, sf):
    lengths = order_frames(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return data.length_mismatch(lengths, order_episodes(spark, sf))


@query(
    "j06_undelivered_features",
    sql(
        ORD,
        """SELECT dataset, 'observation.force' AS feature FROM oi WHERE bal > 5000
UNION ALL SELECT dataset, 'observation.state' FROM oe GROUP BY 1 HAVING bool_and(st = 'P')""",
    ),
)
def undelivered(spark, sf):
    rec = order_recording(spark, sf, inventory=False)
    return files.undelivered_features(rec.features, rec.frames, rec.data_columns())


@query(
    "u06_missing_keys",
    sql(ORD, "SELECT dataset, 'total_episodes' AS key FROM oi WHERE seg = 'BUILDING'"),
)
def missing_keys(spark, sf):
    return files.missing_keys(order_infos(spark, sf))


FIRST = """,
fe AS (SELECT dataset, min(episode_index) AS fe FROM oe GROUP BY 1),
st0 AS (SELECT oe.*, fe, (SELECT x.st = 'P' FROM oe x WHERE x.episode_index = fe) AS first_lacks FROM oe JOIN fe USING (dataset)),
diff AS (SELECT dataset, episode_index, CASE WHEN first_lacks THEN 'extra' ELSE 'missing' END AS difference FROM st0
         WHERE episode_index <> fe AND (st = 'P') <> first_lacks)"""


@query(
    "u02_column_differences",
    sql(ORD + FIRST, "SELECT dataset, episode_index, 'observation.state' AS feature, difference FROM diff"),
)
def column_differences(spark, sf):
    rec = order_recording(spark, sf, inventory=False)
    return files.column_differences(rec.frames, rec.data_columns())


VID = """,
ex AS (SELECT oe.dataset, episode_index, length, 'videos/observation.images.top/chunk-' || lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0') || '/file-' ||
         CASE WHEN episode_index < 1000 THEN lpad(CAST(episode_index AS VARCHAR), 3, '0') ELSE CAST(episode_index AS VARCHAR) END || '.mp4' AS path
       FROM oe JOIN oi USING (dataset) WHERE bal > 0),
mv AS (SELECT ex.* FROM ex LEFT JOIN inv USING (dataset, path) WHERE inv.path IS NULL)"""


@query("j07_missing_videos", sql(ORD + VID, "SELECT dataset, episode_index, path FROM mv"))
def missing_videos(spark, sf):
    rec = order_recording(spark, sf, frames=False)
    expected = files.video_paths(rec.episodes, rec.infos, rec.features)
    return files.missing_videos(expected, rec.inventory).select(*KEYS, "path")


@query(
    "j08_video_loads",
    sql(
        ORD + VID.replace("episode_index // 1000", "episode_index // 1000"),
        """SELECT dataset, path, CAST(sum(length) AS BIGINT) AS expected_frames, count(*) AS episodes FROM ex JOIN inv USING (dataset, path) GROUP BY 1, 2""",
    ),
)
def video_loads(spark, sf):
    rec = order_recording(spark, sf, frames=False)
    loads = files.video_loads(files.video_paths(rec.episodes, rec.infos, rec.features), rec.inventory)
    return loads.select("dataset", "path", "expected_frames", "episodes")


def order_probe(rec) -> DataFrame:
    """Container data of every video: its frames are size/10000, some are off."""
    v = rec.inventory.where(F.col("path").startswith("videos/"))
    n = (F.col("size") / 10000).cast("long")
    yes = F.lit(True)
    return v.select(
        "dataset",
        "path",
        yes.alias("has_ftyp"),
        (n != 2).alias("has_moov"),
        (n != 3).alias("has_mdat"),
        F.lit(1).alias("video_tracks"),
        F.when(n == 4, F.lit(320)).otherwise(F.lit(640)).alias("width"),
        F.lit(480).alias("height"),
        F.when(n == 5, F.lit(30.0)).otherwise(F.lit(10.4)).alias("fps"),
        F.when(n == 6, n + 3).otherwise(n + 2).alias("frames"),
    )


PROBE = VID + """,
vl AS (SELECT dataset, path, CAST(sum(length) AS BIGINT) AS n FROM ex JOIN inv USING (dataset, path) GROUP BY 1, 2),
vr AS (SELECT vl.* FROM vl),
iss AS (SELECT dataset, path, n, unnest(CASE n WHEN 2 THEN ['structure'] WHEN 3 THEN ['no_media'] WHEN 4 THEN ['resolution'] WHEN 5 THEN ['fps']
          WHEN 6 THEN ['frames'] ELSE [] END) AS issue, bal FROM vr JOIN oi USING (dataset)),
iss2 AS (SELECT * FROM iss WHERE NOT (issue = 'fps' AND bal < -500))"""


@query(
    "j09_probe_issues",
    sql(
        ORD + PROBE,
        "SELECT dataset, path, issue, CASE WHEN issue IN ('structure', 'no_media') THEN 'FAIL' ELSE 'WARN' END AS severity FROM iss2",
    ),
)
def probe_issues(spark, sf):
    rec = order_recording(spark, sf, frames=False)
    loads = files.video_loads(files.video_paths(rec.episodes, rec.infos, rec.features), rec.inventory)
    return files.probe_issues(loads, order_probe(rec)).select("dataset", "path", "issue", "severity")


@query(
    "d06_videos",
    sql(
        ORD + PROBE,
        rows(
            f("missing_video", NONE, "mv", severity="FAIL", column="'observation.images.top'"),
            """SELECT dataset, CASE WHEN issue IN ('structure', 'no_media') THEN 'FAIL' ELSE 'WARN' END, NULL, 'observation.images.top', NULL, issue,
  CAST(n AS DOUBLE) FROM iss2""",
        ),
    ),
)
def videos(spark, sf):
    rec = order_recording(spark, sf, frames=False)
    rec.probe = order_probe(rec)
    return typed(files.videos(rec))


@query(
    "d01_metadata",
    sql(
        ORD,
        rows(
            f("missing_key", NONE, "oi WHERE seg = 'BUILDING'", "FAIL", NONE, "'total_episodes'"),
            f("version", NONE, "oi WHERE bal > 8000", "WARN", NONE),
            f("fps", "0", "oi WHERE bal < -500", "FAIL", NONE),
            f("no_episode_files", "0", "oi WHERE NOT has_meta", "WARN", NONE),
            f("no_tasks", "3", "oi", "FAIL", NONE),
            f("total_frames", "frames", "oi WHERE bal > 9500 AND seg <> 'BUILDING'", "FAIL", NONE),
            f("total_episodes", "eps", "oi WHERE bal < 0 AND seg <> 'BUILDING'", "FAIL", NONE),
            f("undelivered_feature", NONE, "oi WHERE bal > 5000", "WARN", NONE, "'observation.force'"),
            f("undelivered_feature", NONE, "(SELECT dataset FROM oe GROUP BY 1 HAVING bool_and(st = 'P'))", "WARN", NONE, "'observation.state'"),
        ),
    ),
)
def metadata(spark, sf):
    return typed(files.metadata(order_recording(spark, sf)))


HEALTH = """,
ra AS (SELECT oe.*, CASE WHEN bal < -500 THEN 1 ELSE 10 END AS fps, avg(n) OVER w AS mu, stddev_pop(n) OVER w AS sd, count(*) OVER w AS m
       FROM oe JOIN oi USING (dataset) WINDOW w AS (PARTITION BY dataset)),
cz AS (SELECT dataset, count(*) AS m, count(*) FILTER (n < 10) AS c10, count(*) FILTER (n < 16) AS c16, count(*) FILTER (n < 20) AS c20,
         count(*) FILTER (n < 50) AS c50, count(*) FILTER (n < 100) AS c100 FROM oe GROUP BY 1),
cc AS (SELECT dataset, CASE WHEN c10 > m * 0.1 THEN 10 WHEN c16 > m * 0.1 THEN 16 WHEN c20 > m * 0.1 THEN 20 WHEN c50 > m * 0.1 THEN 50
         WHEN c100 > m * 0.1 THEN 100 END AS chunk FROM cz),
te AS (SELECT DISTINCT dataset, task_index, episode_index FROM od0),
tc AS (SELECT dataset, task_index, count(*) AS c FROM te GROUP BY 1, 2),
tb AS (SELECT dataset, count(*) AS k, min(c) AS least, max(c) AS most FROM tc GROUP BY 1)"""


@query(
    "d08_episodes",
    sql(
        ORD + HEALTH,
        rows(
            f("short", "n", "ra WHERE n < greatest(5, fps)"),
            f("single_frame", "n", "ra WHERE n <= 1", "FAIL"),
            f("length_spread", "sd / mu", "(SELECT DISTINCT dataset, mu, sd FROM ra) WHERE sd / mu > 1", episode=NONE),
            f("abnormally_short", "n", "ra WHERE sd > 0 AND n < mu - 3 * sd"),
            f("abnormally_long", "n", "ra WHERE sd > 0 AND n > mu + 3 * sd"),
            f("chunk_size", "chunk", "cc WHERE chunk IS NOT NULL", episode=NONE),
            f("length_mismatch", "n", "oe WHERE n <> length", "FAIL"),
            f("task_imbalance", "most / least", "tb WHERE k > 1 AND most > 10 * least", episode=NONE),
        ),
    ),
)
def episode_health(spark, sf):
    return typed(data.episode_health(order_recording(spark, sf, inventory=False)))


@query(
    "a26_task_distribution",
    sql(ORD + HEALTH, "SELECT dataset, CAST(task_index AS BIGINT) AS task_index, c AS episodes FROM tc"),
)
def task_distribution(spark, sf):
    return data.task_distribution(order_frames(spark, sf))


@query(
    "d09_consistency",
    sql(
        ORD + FIRST,
        rows(
            f("missing_column", NONE, "diff WHERE difference = 'missing'", "FAIL", column="'observation.state'"),
            f("extra_column", NONE, "diff WHERE difference = 'extra'", column="'observation.state'"),
        ),
    ),
)
def consistency(spark, sf):
    return typed(files.consistency(order_recording(spark, sf, inventory=False)))


@query(
    "d10_training",
    sql(
        ORD,
        rows(
            f("no_image", NONE, "oi WHERE bal <= 0", episode=NONE),
            f("no_action_stats", NONE, "oi WHERE bal > 4000", episode=NONE),
            f("missing_field", NONE, "oi WHERE bal BETWEEN 2000 AND 4000", episode=NONE, column="'action'"),
            f("zero_std", "1", "oi WHERE bal > 0 AND bal < 2000", episode=NONE, column="'action'"),
            f("no_stats", NONE, "oi WHERE bal <= 0", episode=NONE),
            f("horizon", "shortest", "oi WHERE NOT bal < -500 AND shortest < 17", episode=NONE),
        ),
    ),
)
def training(spark, sf):
    # Statistics derived from the balance: absent, without actions, without std, or with a zero std.
    rec = order_recording(spark, sf, inventory=False)
    from trajlake.plans.views import table

    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset"), "c_acctbal")
    c = c.join(rec.datasets(), "dataset").where("c_acctbal > 0")
    bal = F.col("c_acctbal")
    feature = F.when(bal > 4000, "observation.state").otherwise("action")
    mean = c.select("dataset", feature.alias("feature"), F.lit("mean").alias("field"), F.lit(0).alias("dim"), bal.alias("value"))
    std = c.where("c_acctbal < 2000 or c_acctbal > 4000").select(
        "dataset", feature.alias("feature"), F.lit("std").alias("field"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dim"), bal.alias("value")
    ).withColumn("value", F.when(F.col("dim") == 1, F.lit(0.0)).otherwise(F.col("value")))
    rec.stored_stats = mean.unionByName(std)
    return typed(files.training(rec))


@query(
    "d12_portability",
    sql(
        ORD + ", iv AS (SELECT dataset, count(*) FILTER (size = 40000) AS sl, count(*) FILTER (size = 3000) AS ur FROM inv GROUP BY 1)",
        rows(
            f("symlinks", "sl", "iv WHERE sl > 0", episode=NONE),
            f("unreadable", "ur", "iv WHERE ur > 0", "FAIL", NONE),
            f("absolute_path", NONE, "oi WHERE bal > 9000", "FAIL", NONE, "'data_path'"),
            f("not_template", NONE, "oi WHERE bal > 9000", "WARN", NONE, "'data_path'"),
        ),
    ),
)
def portability(spark, sf):
    return typed(files.portability(order_recording(spark, sf, frames=False)))


@query(
    "a27_severity_counts",
    sql(
        ORD + HEALTH + FIRST + """,
bad AS (SELECT DISTINCT dataset, 'c' AS ck, 2 AS s FROM diff WHERE difference = 'missing' UNION ALL SELECT DISTINCT dataset, 'c', 1 FROM diff WHERE difference = 'extra'
        UNION ALL SELECT dataset, 'p', 2 FROM oi WHERE bal > 9000 OR dataset IN (SELECT dataset FROM inv WHERE size = 3000)
        UNION ALL SELECT dataset, 'p', 1 FROM inv WHERE size = 40000),
sv AS (SELECT oi.dataset, k.ck, coalesce(max(s), 0) AS s FROM oi CROSS JOIN (SELECT unnest(['c', 'p']) AS ck) k LEFT JOIN bad ON bad.dataset = oi.dataset AND bad.ck = k.ck GROUP BY 1, 2)""",
        """SELECT dataset, CASE max(s) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS severity, count(*) FILTER (s = 0) AS pass,
  count(*) FILTER (s = 1) AS warn, count(*) FILTER (s = 2) AS fail FROM sv GROUP BY 1""",
    ),
)
def severities(spark, sf):
    rec = order_recording(spark, sf)
    return severity_counts(cut(report.run(rec, ["consistency", "portability"])))


@query(
    "a28_affected_episodes",
    sql(COARSE, "SELECT dataset, episode_index FROM fr WHERE share >= 0.05 UNION SELECT dataset, episode_index FROM sfr WHERE share >= 0.05 UNION SELECT dataset, episode_index FROM jp"),
)
def affected(spark, sf):
    return affected_episodes(data.actions(dirty(spark, sf)))


@query("d14_report")
def full_report(spark, sf):
    rec = dirty(spark, sf)
    found = report.run(rec, ["temporal", "actions", "statistics", "anomalies", "per_episode"])
    return check_summary(cut(found))


def order_report(spark, sf, checks=None):
    rec = order_recording(spark, sf)
    rec.names = pose_names(spark)
    return check_summary(cut(report.run(rec, checks)))


@query("d14_all_checks")
def all_checks(spark, sf):
    return order_report(spark, sf)

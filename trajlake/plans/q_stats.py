"""Queries over vector statistics and frame-to-frame checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import round_half_up
from trajlake.operators import motion_checks as mc
from trajlake.operators import stats
from trajlake.operators.blocks import KEYS, episode_lengths
from trajlake.plans.oracle import EMB, EV, EV_LONG, LI, LI_LONG, r, sql
from trajlake.plans.registry import query
from trajlake.plans.views import emb_frames, ev_frames, li_frames
from trajlake.session import cut


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, round_half_up(F.col(c), digits))
    return df


@query(
    "a01_vector_summary",
    sql(
        LI_LONG,
        f"""SELECT dataset, CAST(dim AS INT) AS dim, count(*) AS count, {r('avg(x)')} AS mean,
  {r('stddev_pop(x)')} AS std, min(x) AS minimum, max(x) AS maximum,
  count(*) FILTER (x = lo) AS at_minimum, count(*) FILTER (x = hi) AS at_maximum
FROM (SELECT *, min(x) OVER (PARTITION BY dataset, dim) AS lo, max(x) OVER (PARTITION BY dataset, dim) AS hi FROM lil)
GROUP BY dataset, dim""",
    ),
)
def vector_summary(spark, sf):
    m = stats.prepare(li_frames(spark, sf), "action")
    full = stats.extremes_share(m, "action", cut(stats.column_summary(m, "action")))
    return rounded(full, "mean", "std").select(
        "dataset", "dim", "count", "mean", "std", "minimum", "maximum", "at_minimum", "at_maximum"
    )


@query(
    "a02_diff_summary",
    sql(
        LI_LONG,
        f"""SELECT dataset, CAST(dim AS INT) AS dim, count(d) AS count, {r('avg(d)')} AS mean,
  {r('stddev_pop(d)')} AS std, {r('min(d)')} AS minimum, {r('max(d)')} AS maximum
FROM lid WHERE d IS NOT NULL GROUP BY dataset, dim""",
    ),
)
def diff_summary(spark, sf):
    out = stats.diff_summary(li_frames(spark, sf), "action")
    return rounded(out, "mean", "std", "minimum", "maximum").select(
        "dataset", "dim", "count", "mean", "std", "minimum", "maximum"
    )


@query(
    "a03_subset_summary",
    sql(
        LI_LONG
        + """, pick AS (SELECT dataset, episode_index FROM li GROUP BY 1, 2 HAVING avg(price) > 50000)""",
        f"""SELECT dataset, CAST(dim AS INT) AS dim, count(*) AS count, {r('avg(x)')} AS mean,
  {r('stddev_pop(x)')} AS std, min(x) AS minimum, max(x) AS maximum
FROM lil JOIN pick USING (dataset, episode_index) GROUP BY dataset, dim""",
    ),
)
def subset_summary(spark, sf):
    frames = li_frames(spark, sf)
    chosen = (
        frames.groupBy(*KEYS)
        .agg(F.avg(F.col("`observation.state`")[0]).alias("_m"))
        .where("_m > 50000")
    )
    out = stats.column_summary(frames, "action", chosen)
    return rounded(out, "mean", "std").select(
        "dataset", "dim", "count", "mean", "std", "minimum", "maximum"
    )


@query(
    "a31_distribution_shift",
    sql(
        LI_LONG
        + """,
eps AS (SELECT dataset, episode_index, row_number() OVER (PARTITION BY dataset ORDER BY episode_index) - 1 AS rk,
               count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT DISTINCT dataset, episode_index FROM li)),
side AS (SELECT *, CASE WHEN rk < m // 4 THEN 0 WHEN rk >= m - m // 4 THEN 1 END AS part FROM eps WHERE m >= 10),
st AS (SELECT dataset, dim, part, avg(x) AS mean, stddev_pop(x) AS std FROM lil JOIN side USING (dataset, episode_index)
       WHERE part IS NOT NULL GROUP BY dataset, dim, part),
sh AS (SELECT a.dataset, a.dim, abs(b.mean - a.mean) / CASE WHEN a.std = 0 THEN 1 ELSE a.std END AS shift
       FROM st a JOIN st b ON a.dataset = b.dataset AND a.dim = b.dim AND a.part = 0 AND b.part = 1)""",
        f"""SELECT dataset, CAST(arg_max(dim, shift) AS INT) AS dim, {r('max(shift)')} AS shift, max(shift) > 3 AS shifted
FROM sh GROUP BY dataset""",
    ),
)
def distribution_shift(spark, sf):
    from trajlake.operators.episodes import episode_rank

    frames = li_frames(spark, sf)
    out = stats.distribution_shift(frames, "action", episode_rank(frames))
    return rounded(out, "shift")


@query(
    "a32_extreme_outliers",
    sql(
        LI_LONG
        + """, m AS (SELECT dataset, dim, avg(x) AS mu, stddev_pop(x) AS sd FROM lil GROUP BY 1, 2)""",
        """SELECT dataset, CAST(dim AS INT) AS dim, count(*) FILTER (abs(x - mu) / sd > 1.5) AS outliers
FROM lil JOIN m USING (dataset, dim) GROUP BY dataset, dim""",
    ),
)
def extreme_outliers(spark, sf):
    m = stats.prepare(li_frames(spark, sf), "action")
    return stats.outlier_counts(m, "action", cut(stats.column_summary(m, "action")), limit=1.5)


@query(
    "a33_clip_share",
    sql(
        LI_LONG,
        f"""SELECT dataset, CAST(dim AS INT) AS dim, {r('count(*) FILTER (x = lo) / count(*)')} AS min_share,
  {r('count(*) FILTER (x = hi) / count(*)')} AS max_share
FROM (SELECT *, min(x) OVER (PARTITION BY dataset, dim) AS lo, max(x) OVER (PARTITION BY dataset, dim) AS hi FROM lil)
WHERE lo <> hi GROUP BY dataset, dim HAVING count(*) > 10""",
    ),
)
def clip_share(spark, sf):
    m = stats.prepare(li_frames(spark, sf), "action")
    full = stats.extremes_share(m, "action", cut(stats.column_summary(m, "action")))
    out = stats.clip_share(full)
    return rounded(out, "min_share", "max_share").select("dataset", "dim", "min_share", "max_share")


@query(
    "a34_constant_dims",
    """WITH e AS (
  SELECT label, 0 AS dim, 1.0 AS x FROM embeddings
  UNION ALL SELECT label, 1, CAST(embedding[1] AS DOUBLE) FROM embeddings
  UNION ALL SELECT label, 2, CAST(label AS DOUBLE) FROM embeddings)
SELECT CAST(label AS VARCHAR) AS dataset, dim, min(x) AS value, CAST(3 AS BIGINT) AS dims, CAST(2 AS BIGINT) AS constant_dims,
       false AS all_constant
FROM e GROUP BY label, dim HAVING min(x) = max(x)""",
)
def constant_dims(spark, sf):
    # A dataset per label, so the label itself is a constant dimension.
    frames = emb_frames(spark, sf).select(
        F.col("episode_index").cast("string").alias("dataset"),
        F.pmod("position", F.lit(7)).alias("episode_index"),
        F.floor(F.col("position") / 7).alias("position"),
        F.array(F.lit(1.0), F.col("action")[0], F.col("episode_index").cast("double")).alias("state"),
    )
    return stats.constant_dims(stats.column_summary(frames, "state"))


@query(
    "w01_frame_delta",
    sql(
        EV,
        """SELECT dataset, episode_index, position,
  floor((value - lag(value) OVER w) * 1e6 + 0.5) / 1e6 AS d0, floor((k - lag(k) OVER w) * 1e6 + 0.5) / 1e6 AS d1
FROM ev WINDOW w AS (PARTITION BY episode_index ORDER BY position)""",
    ),
)
def frame_delta(spark, sf):
    steps = stats.with_previous(ev_frames(spark, sf), "action")
    d = stats.difference(F.col("v"), F.col("p"))
    return steps.select(
        *KEYS,
        "position",
        round_half_up(d[0], 6).alias("d0"),
        round_half_up(d[1], 6).alias("d1"),
    )


@query(
    "w02_timestamp_checks",
    sql(
        EV + ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY episode_index ORDER BY position) AS dt FROM ev)",
        f"""SELECT dataset, episode_index, count(*) FILTER (dt <= 0) AS non_monotonic,
  count(*) FILTER (dt > 1.5 * 39600) AS gaps, {r('avg(dt) FILTER (dt > 0)', 3)} AS mean_interval,
  abs(avg(dt) FILTER (dt > 0) - 39600) > 3960 AS drifts
FROM d WHERE dt IS NOT NULL GROUP BY dataset, episode_index""",
    ),
)
def timestamp_checks(spark, sf):
    rates = spark.createDataFrame([("events", 1.0 / 39600)], "dataset string, fps double")
    out = mc.clock_issues(ev_frames(spark, sf), rates)
    return rounded(out, "mean_interval", digits=3).drop("fps")


@query(
    "w03_frame_index_continuity",
    sql(
        EV,
        """SELECT dataset, episode_index, count(*) AS mismatches, min(position) AS first_position,
  arg_min(task_index + position, position) AS first_value
FROM ev WHERE task_index = 3 GROUP BY dataset, episode_index""",
    ),
)
def frame_index_continuity(spark, sf):
    # The declared index is wrong by 3 on the frames of one event type.
    frames = ev_frames(spark, sf)
    wrong = F.when(F.col("task_index") == 3, F.col("position") + 3).otherwise(F.col("position"))
    return mc.frame_index_mismatches(frames.withColumn("frame_index", wrong))


@query(
    "w04_global_index_continuity",
    sql(
        EV
        + """, o AS (SELECT dataset, event_id, episode_index, position,
  lag(event_id) OVER (ORDER BY episode_index, position) AS p FROM ev)""",
        """SELECT dataset, count(*) FILTER (p IS NOT NULL AND event_id <> p + 1) AS breaks,
  arg_min(event_id, (episode_index, position)) AS first_index FROM o GROUP BY dataset""",
    ),
)
def global_index_continuity(spark, sf):
    return mc.global_index_breaks(ev_frames(spark, sf))


@query(
    "w05_longest_frozen_run",
    sql(
        LI
        + """,
f AS (SELECT dataset, episode_index, position, n,
        CASE WHEN lag(dc) OVER w IS NOT NULL AND floor(q / 20) = floor(lag(q) OVER w / 20) THEN 0 ELSE 1 END AS chg
      FROM li WINDOW w AS (PARTITION BY dataset, episode_index ORDER BY position)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY dataset, episode_index ORDER BY position) AS island FROM f),
runs AS (SELECT dataset, episode_index, max(n) AS n, count(*) - 1 AS len FROM g GROUP BY dataset, episode_index, island)""",
        f"""SELECT dataset, episode_index, max(n) AS n, max(len) AS longest_run, {r('max(len) / max(n)')} AS frozen_share
FROM runs GROUP BY dataset, episode_index""",
    ),
)
def frozen_run(spark, sf):
    # A coarse copy of the first action dim, so equal neighbours occur.
    frames = li_frames(spark, sf).withColumn("action", F.array(F.floor(F.col("action")[0] / 20).cast("double")))
    return rounded(mc.longest_frozen_run(frames, "action"), "frozen_share")


@query(
    "w06_mean_z_jumps",
    sql(
        LI_LONG,
        """SELECT dataset, episode_index, count(*) FILTER (mz > 1.8) AS jumps
FROM (SELECT dataset, episode_index, position, sum(z) / 3 AS mz FROM liz WHERE n >= 3 GROUP BY 1, 2, 3)
GROUP BY dataset, episode_index""",
    ),
)
def mean_z_jumps(spark, sf):
    m = stats.prepare(li_frames(spark, sf), "action")
    return mc.mean_jumps(m, "action", threshold=1.8, scales=cut(stats.step_scales(m, "action")))


@query(
    "w07_coordinated_jumps",
    sql(
        LI_LONG
        + """,
ev2 AS (SELECT dataset, episode_index, position, max(z) AS mz, count(*) FILTER (z > 1.9) AS over_dims,
          count(*) FILTER (z > 1.2) AS reported
        FROM liz GROUP BY 1, 2, 3),
hit AS (SELECT * FROM ev2 WHERE over_dims >= 2 OR mz > 2.35),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, episode_index ORDER BY floor(mz * 1e6 + 0.5) DESC, position) AS rank,
         count(*) OVER (PARTITION BY dataset, episode_index) AS events FROM hit)""",
        f"""SELECT dataset, episode_index, position, CAST(rank AS INT) AS rank, {r('mz')} AS max_z,
  CAST(over_dims AS INT) AS dims_over, CAST(reported AS INT) AS reported, events, greatest(events - 5, 0) AS more
FROM rk WHERE rank <= 5""",
    ),
)
def coordinated_jumps(spark, sf):
    m = stats.prepare(li_frames(spark, sf), "action")
    scales = cut(stats.step_scales(m, "action"))
    hits = mc.dimension_jumps(m, "action", threshold=1.9, extreme=2.35, report=1.2, scales=scales)
    # The events are few; both the ranking and the counting read them.
    hits = cut(rounded(hits, "max_z").withColumn("reported", F.size("reported")))
    return mc.top_per_group(hits, KEYS, [F.desc("max_z"), "position"])


@query(
    "w12_stuck_dims",
    sql(
        LI_LONG
        + """,
s AS (SELECT dataset, episode_index, dim, max(n) AS n, count(*) FILTER (floor(x * 2) = floor(p * 2)) AS same
      FROM lid GROUP BY 1, 2, 3 HAVING min(floor(x * 2)) <> max(floor(x * 2)) AND max(n) >= 5)""",
        f"""SELECT dataset, episode_index, CAST(dim AS INT) AS dim, n, same AS unchanged, {r('same / (n - 1)')} AS share FROM s""",
    ),
)
def stuck(spark, sf):
    frames = li_frames(spark, sf).withColumn(
        "action", F.transform("action", lambda x: F.floor(x * 2).cast("double"))
    )
    return rounded(mc.stuck_share(frames, "action"), "share")


@query(
    "u01_missing_episodes",
    """WITH ids AS (SELECT l_returnflag AS dataset, l_suppkey AS id FROM lineitem
             GROUP BY 1, 2 HAVING sum(l_quantity) > avg(l_quantity) * 200),
b AS (SELECT dataset, min(id) AS lo, max(id) AS hi FROM ids GROUP BY dataset),
allids AS (SELECT dataset, unnest(range(lo, hi + 1)) AS id FROM b)
SELECT dataset, id AS episode_index FROM allids EXCEPT SELECT dataset, id FROM ids""",
)
def missing_episodes(spark, sf):
    per = li_frames(spark, sf).groupBy(*KEYS).agg(
        F.sum(F.col("action")[0]).alias("s"), F.avg(F.col("action")[0]).alias("a")
    )
    return mc.missing_episodes(per.where(F.col("s") > F.col("a") * 200))


@query(
    "u01_missing_ranges",
    """WITH ids AS (SELECT l_returnflag AS dataset, l_suppkey AS id FROM lineitem
             GROUP BY 1, 2 HAVING sum(l_quantity) > avg(l_quantity) * 200),
n AS (SELECT dataset, id, lead(id) OVER (PARTITION BY dataset ORDER BY id) AS next FROM ids)
SELECT dataset, id + 1 AS "first", next - 1 AS "last", next - id - 1 AS missing FROM n WHERE next > id + 1""",
)
def missing_ranges(spark, sf):
    per = li_frames(spark, sf).groupBy(*KEYS).agg(
        F.sum(F.col("action")[0]).alias("s"), F.avg(F.col("action")[0]).alias("a")
    )
    return mc.missing_ranges(per.where(F.col("s") > F.col("a") * 200))


@query(
    "d03_bad_values",
    sql(
        LI,
        """SELECT dataset, episode_index, count(*) FILTER (q = 1) AS nan_count, count(*) FILTER (q = 2) AS inf_count
FROM li WHERE q IN (1, 2) GROUP BY dataset, episode_index""",
    ),
)
def bad_values(spark, sf):
    # Two quantity values stand for NaN and infinity readings.
    q = F.col("action")[0]
    dirty = F.when(q == 1, F.lit(float("nan"))).when(q == 2, F.lit(float("inf"))).otherwise(q)
    frames = li_frames(spark, sf).withColumn("action", F.array(dirty, F.col("action")[1]))
    return mc.bad_values(frames, "action")

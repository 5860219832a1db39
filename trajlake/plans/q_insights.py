"""Queries over cross-episode statistics, episode lengths and sampling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.operators import episodes as ep
from trajlake.operators import insights as ins
from trajlake.operators.blocks import KEYS, episode_lengths
from trajlake.plans.oracle import EV, EV_LONG, LI, LI_LONG, r, sql
from trajlake.plans.q_stats import rounded
from trajlake.plans.registry import query
from trajlake.plans.views import ev_frames, li_frames
from trajlake.session import cut

MOVE = """,
mv AS (SELECT dataset, episode_index, max(n) AS n, floor(avg(st) * 1e4 + 0.5) / 1e4 AS movement
       FROM (SELECT dataset, episode_index, position, max(n) AS n, sqrt(sum(d * d)) AS st FROM evd GROUP BY 1, 2, 3)
       GROUP BY 1, 2)"""

RANGES = """,
rg AS (SELECT dataset, dim, min(x) AS lo, max(x) AS hi,
         CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END AS motor_range,
         count(DISTINCT x) AS dv FROM evl GROUP BY 1, 2)"""

ACTIVE = (
    RANGES
    + """,
st AS (SELECT evd.*, motor_range FROM evd JOIN rg USING (dataset, dim) WHERE d IS NOT NULL),
act AS (SELECT dataset, episode_index, dim, max(n) AS n, count(*) AS steps, sum(abs(d) / motor_range) AS path,
          list_sort(list(abs(d)))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95, max(motor_range) AS motor_range
        FROM st GROUP BY 1, 2, 3),
actf AS (SELECT *, p95 >= motor_range * 0.001 AS active FROM act)"""
)

VEL = (
    ACTIVE
    + """,
dead AS (SELECT dataset, dim, NOT bool_or(active) AS inactive FROM actf GROUP BY 1, 2),
vel AS (SELECT st.dataset, st.dim, st.d / st.motor_range AS v FROM st
        JOIN actf a ON a.dataset = st.dataset AND a.episode_index = st.episode_index AND a.dim = st.dim
        JOIN dead z ON z.dataset = st.dataset AND z.dim = st.dim WHERE a.active OR z.inactive),
vs AS (SELECT dataset, dim, stddev_pop(v) AS std, max(abs(v)) AS max_abs, min(v) AS lo, max(v) AS hi, count(*) AS steps
       FROM vel GROUP BY 1, 2)"""
)

# A sparse copy of the second dim, still in most episodes, so that inactive dims occur.
SPARSE = EV_LONG.replace("1 AS dim, k AS x", "1 AS dim, CASE WHEN k > 96 THEN k ELSE 0 END AS x")


def ev(spark, sf):
    return ev_frames(spark, sf)


def sparse(spark, sf):
    k = F.col("action")[1]
    return ev(spark, sf).withColumn(
        "action", F.array(F.col("action")[0], F.when(k > 96, k).otherwise(F.lit(0.0)))
    )


@query(
    "a10_time_variance",
    sql(
        LI_LONG
        + """,
b AS (SELECT DISTINCT dataset, episode_index, n, unnest(range(0, 50)) AS bin FROM li),
src AS (SELECT *, least(CAST(floor(bin / 49.0 * (n - 1) + 0.5) AS BIGINT), n - 1) AS position FROM b)""",
        f"""SELECT dataset, CAST(bin AS INT) AS bin, CAST(dim AS INT) AS dim, count(*) AS episodes, {r('var_pop(x)', 4)} AS variance
FROM src JOIN lil USING (dataset, episode_index, position) GROUP BY dataset, bin, dim""",
    ),
)
def time_variance(spark, sf):
    return rounded(ins.time_variance(li_frames(spark, sf)), "variance", digits=4)


@query("a11_movement_score", sql(EV_LONG + MOVE, "SELECT dataset, episode_index, n, movement FROM mv"))
def movement(spark, sf):
    return ins.movement(ev(spark, sf))


@query(
    "t02_low_movement",
    sql(
        EV_LONG + MOVE,
        """SELECT * FROM (SELECT dataset, episode_index, n, movement,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY movement, episode_index) AS INT) AS rank FROM mv) WHERE rank <= 10""",
    ),
)
def low_movement(spark, sf):
    return ins.lowest(ins.movement(ev(spark, sf)), "movement", 10)


@query(
    "a12_motor_range",
    sql(
        SPARSE + RANGES,
        """SELECT dataset, CAST(dim AS INT) AS dim, lo, hi, motor_range, CAST(least(dv, 5) AS INT) AS distinct_values, dv <= 4 AS discrete
FROM rg""",
    ),
)
def motor_range(spark, sf):
    return ins.motor_ranges(sparse(spark, sf))


@query(
    "a13_activity",
    sql(SPARSE + ACTIVE, "SELECT dataset, episode_index, CAST(dim AS INT) AS dim, n, steps, active FROM actf"),
)
def activity(spark, sf):
    frames = sparse(spark, sf)
    return ins.activity(frames, cut(ins.motor_ranges(frames))).drop("scaled_path")


@query(
    "a14_velocity_distribution",
    sql(
        SPARSE + VEL,
        f"""SELECT dataset, CAST(dim AS INT) AS dim, motor_range, dv <= 4 AS discrete, inactive, {r('std')} AS std, {r('max_abs')} AS max_abs,
  {r('vs.lo')} AS lo, {r('vs.hi')} AS hi, steps FROM rg JOIN dead USING (dataset, dim) JOIN vs USING (dataset, dim)""",
    ),
)
def velocity(spark, sf):
    frames = sparse(spark, sf)
    ranges = cut(ins.motor_ranges(frames))
    out, _ = ins.velocity_stats(frames, ranges, cut(ins.activity(frames, ranges)))
    return rounded(out, "std", "max_abs", "lo", "hi")


@query(
    "a14_velocity_bins",
    sql(
        SPARSE + VEL,
        """SELECT dataset, CAST(dim AS INT) AS dim,
  CAST(least(floor((v - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END / 30)), 29) AS INT) AS bin, count(*) AS steps
FROM vel JOIN vs USING (dataset, dim) GROUP BY 1, 2, 3""",
    ),
)
def velocity_bins(spark, sf):
    frames = sparse(spark, sf)
    ranges = cut(ins.motor_ranges(frames))
    return ins.velocity_stats(frames, ranges, cut(ins.activity(frames, ranges)))[1]


ACF = """,
c AS (SELECT *, x - avg(x) OVER (PARTITION BY episode_index, dim) AS cx FROM evl),
v0 AS (SELECT episode_index, dim, sum(cx * cx) AS v, min(x) = max(x) AS const FROM c GROUP BY 1, 2),
lim AS (SELECT DISTINCT dataset, episode_index, least(100, n // 2) AS lags FROM ev WHERE n // 2 >= 2),
lg AS (SELECT dataset, episode_index, unnest(range(1, lags + 1)) AS lag FROM lim),
pr AS (SELECT a.episode_index, a.dim, lg.lag, sum(a.cx * b.cx) AS s
       FROM c a JOIN lg ON a.dataset = lg.dataset AND a.episode_index = lg.episode_index
       JOIN c b ON a.episode_index = b.episode_index AND a.dim = b.dim AND b.position = a.position + lg.lag GROUP BY 1, 2, 3),
acf AS (SELECT lg.dataset, pr.dim, pr.lag, avg(CASE WHEN const OR v = 0 THEN 0 ELSE s / v END) AS acf, count(*) AS episodes
        FROM pr JOIN v0 USING (episode_index, dim) JOIN lg USING (episode_index, lag) GROUP BY 1, 2, 3)"""


@query(
    "a15_autocorrelation",
    sql(EV_LONG + ACF, f"SELECT dataset, CAST(dim AS INT) AS dim, CAST(lag AS INT) AS lag, {r('acf')} AS acf, episodes FROM acf"),
)
def autocorrelation(spark, sf):
    return rounded(ins.autocorrelation(ev(spark, sf)), "acf")


@query(
    "a16_suggested_chunk",
    sql(
        EV_LONG + ACF + ", f AS (SELECT dataset, dim, min(lag) AS lag FROM acf WHERE acf < 0.5 GROUP BY 1, 2)",
        "SELECT dataset, CAST(list_sort(list(lag))[count(*) // 2 + 1] AS INT) AS suggested_chunk FROM f GROUP BY dataset",
    ),
)
def suggested_chunk(spark, sf):
    return ins.suggested_chunk(cut(ins.autocorrelation(ev(spark, sf))))


JERK = """,
jk AS (SELECT dataset, episode_index, coalesce(sum(path) FILTER (active) / sum(steps) FILTER (active), 0) AS jerkiness
       FROM actf GROUP BY 1, 2)"""


@query(
    "a17_jerkiness",
    sql(SPARSE + ACTIVE + JERK, f"SELECT dataset, episode_index, {r('jerkiness')} AS jerkiness FROM jk"),
)
def jerkiness(spark, sf):
    frames = sparse(spark, sf)
    return rounded(ins.jerkiness(ins.activity(frames, cut(ins.motor_ranges(frames)))), "jerkiness")


@query(
    "t03_jerky_ranking",
    sql(
        SPARSE + ACTIVE + JERK,
        f"""SELECT * FROM (SELECT dataset, episode_index, {r('jerkiness')} AS jerkiness,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY {r('jerkiness')} DESC, episode_index) AS INT) AS rank FROM jk) WHERE rank <= 15""",
    ),
)
def jerky_ranking(spark, sf):
    frames = sparse(spark, sf)
    scores = rounded(ins.jerkiness(ins.activity(frames, cut(ins.motor_ranges(frames)))), "jerkiness")
    return ins.lowest(scores, "jerkiness", 15, descending=True)


NAMES = (
    [("events", 0, "value"), ("events", 1, "k")],
    [("events", 0, "value"), ("events", 1, "k")],
    "dataset string, dim int, name string",
)


def pairs(spark):
    a, s, schema = NAMES
    return cut(ins.pair_dims(spark.createDataFrame(a, schema), spark.createDataFrame(s, schema)))


CC = """,
dd AS (SELECT dataset, episode_index, dim, position, n, d - avg(d) OVER w AS a, ds - avg(ds) OVER w AS s
       FROM evd WHERE d IS NOT NULL WINDOW w AS (PARTITION BY episode_index, dim)),
lg AS (SELECT unnest(range(-30, 31)) AS lag),
cc AS (SELECT x.dataset, x.episode_index, x.dim AS pair, lag, sum(x.a * y.s) AS num, sqrt(sum(x.a * x.a) * sum(y.s * y.s)) AS den
       FROM dd x CROSS JOIN lg JOIN dd y ON x.episode_index = y.episode_index AND x.dim = y.dim AND y.position = x.position + lag
       WHERE x.n >= 10 GROUP BY 1, 2, 3, 4),
cor AS (SELECT dataset, pair, lag, coalesce(avg(num / den) FILTER (den > 0), 0) AS correlation FROM cc GROUP BY 1, 2, 3),
env AS (SELECT dataset, lag, max(correlation) AS mx, avg(correlation) AS mean, min(correlation) AS mn FROM cor GROUP BY 1, 2)"""


@query(
    "a18_cross_correlation",
    sql(
        EV_LONG + CC,
        f"SELECT dataset, CAST(pair AS INT) AS pair, CAST(lag AS INT) AS lag, {r('correlation')} AS correlation FROM cor",
    ),
)
def cross_correlation(spark, sf):
    return rounded(ins.cross_correlation(ev(spark, sf), pairs(spark)), "correlation")


@query(
    "a18_alignment_envelope",
    sql(
        EV_LONG + CC,
        f"""SELECT dataset, CAST(lag AS INT) AS lag, {r('mx')} AS "max", {r('mean')} AS mean, {r('mn')} AS "min" FROM env""",
    ),
)
def alignment_envelope(spark, sf):
    out = ins.alignment_envelope(cut(ins.cross_correlation(ev(spark, sf), pairs(spark))))
    return rounded(out, "max", "mean", "min")


@query(
    "a19_alignment_peaks",
    sql(
        EV_LONG
        + CC
        + """,
own AS (SELECT dataset, pair, arg_max(lag, correlation) AS lag FROM cor GROUP BY 1, 2),
sp AS (SELECT dataset, min(lag) AS lo, max(lag) AS hi, count(*) AS pairs FROM own GROUP BY 1)""",
        f"""SELECT dataset, CAST(arg_max(lag, mean) AS INT) AS mean_peak_lag, CAST(arg_max(lag, mx) AS INT) AS max_peak_lag,
  CAST(arg_max(lag, mn) AS INT) AS min_peak_lag, {r('max(mean)')} AS mean_peak, {r('max(mx)')} AS max_peak, {r('max(mn)')} AS min_peak,
  CAST(max(lo) AS INT) AS lag_low, CAST(max(hi) AS INT) AS lag_high, max(pairs) AS pairs FROM env JOIN sp USING (dataset) GROUP BY dataset""",
    ),
)
def alignment_peaks(spark, sf):
    out = ins.alignment_peaks(cut(ins.cross_correlation(ev(spark, sf), pairs(spark))))
    return rounded(out, "mean_peak", "max_peak", "min_peak")


SPEED = """,
sd AS (SELECT dataset, count(*) AS episodes, avg(movement) AS mean, stddev_pop(movement) AS std, min(movement) AS lo,
         max(movement) AS hi, list_sort(list(movement))[count(*) // 2 + 1] AS median,
         CASE WHEN avg(movement) > 0 THEN stddev_pop(movement) / avg(movement) ELSE 0 END AS cv,
         CAST(least(30, ceil(sqrt(count(*)))) AS INT) AS bins FROM mv GROUP BY 1 HAVING count(*) >= 3),
sdw AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE hi - lo END / bins AS bin_width FROM sd)"""


@query(
    "a20_speed_distribution",
    sql(
        EV_LONG + MOVE + SPEED,
        f"""SELECT dataset, episodes, {r('mean')} AS mean, {r('std')} AS std, lo, hi, median, {r('cv')} AS cv, bins, {r('bin_width')} AS bin_width,
  CASE WHEN cv < 0.2 THEN 'consistent' WHEN cv < 0.4 THEN 'moderate' ELSE 'high' END AS verdict FROM sdw""",
    ),
)
def speed_distribution(spark, sf):
    return rounded(ins.speed_distribution(cut(ins.movement(ev(spark, sf)))), "mean", "std", "cv", "bin_width")


@query(
    "a20_speed_histogram",
    sql(
        EV_LONG + MOVE + SPEED,
        """SELECT dataset, CAST(least(floor((movement - lo) / bin_width), bins - 1) AS INT) AS bin, count(*) AS episodes
FROM mv JOIN sdw USING (dataset) GROUP BY 1, 2""",
    ),
)
def speed_histogram(spark, sf):
    scores = cut(ins.movement(ev(spark, sf)))
    return ins.speed_histogram(scores, ins.speed_distribution(scores))


@query(
    "a21_smoothness_verdict",
    sql(
        EV_LONG
        + VEL
        + """,
u AS (SELECT vs.dataset, vs.dim, std, std / max(std) OVER (PARTITION BY vs.dataset) AS share FROM vs
      JOIN dead USING (dataset, dim) JOIN rg USING (dataset, dim) WHERE NOT inactive AND dv > 4),
cn AS (SELECT dataset, count(*) AS active, count(*) FILTER (share < 0.4) AS smooth, count(*) FILTER (share >= 0.4 AND share < 0.7) AS moderate,
         count(*) FILTER (share >= 0.7) AS jerky, count(*) FILTER (share >= 0.7 AND dim <> 1) AS jerky_joints FROM u GROUP BY 1)""",
        """SELECT *, CASE WHEN active = 0 THEN 'na' WHEN smooth / active >= 0.6 AND jerky_joints = 0 THEN 'smooth'
  WHEN jerky_joints <= 2 AND smooth / active >= 0.3 THEN 'moderate' ELSE 'jerky' END AS verdict FROM cn""",
    ),
)
def smoothness(spark, sf):
    frames = ev(spark, sf)
    ranges = cut(ins.motor_ranges(frames))
    out, _ = ins.velocity_stats(frames, ranges, cut(ins.activity(frames, ranges)))
    names = spark.createDataFrame(
        [("events", 0, "joint"), ("events", 1, "left_gripper")], "dataset string, dim int, name string"
    )
    return ins.smoothness(out, names)


@query(
    "a22_episode_autocorrelation",
    sql(
        EV_LONG
        + """,
c AS (SELECT *, x - avg(x) OVER (PARTITION BY episode_index, dim) AS cx FROM evl),
v0 AS (SELECT episode_index, dim, sum(cx * cx) AS v FROM c GROUP BY 1, 2),
pr AS (SELECT a.episode_index, a.dim, b.position - a.position AS lag, sum(a.cx * b.cx) AS s FROM c a
       JOIN c b ON a.episode_index = b.episode_index AND a.dim = b.dim AND b.position > a.position
         AND b.position - a.position <= least(100, a.n // 2) GROUP BY 1, 2, 3)""",
        f"""SELECT 'events#' || episode_index AS dataset, CAST(dim AS INT) AS dim, CAST(lag AS INT) AS lag, {r('s / v')} AS acf
FROM pr JOIN v0 USING (episode_index, dim)""",
    ),
)
def episode_autocorrelation(spark, sf):
    return rounded(ins.autocorrelation(ins.each_episode(ev(spark, sf))), "acf").drop("episodes")


@query(
    "a22_episode_alignment",
    sql(
        EV_LONG + CC,
        f"""SELECT 'events#' || episode_index AS dataset, CAST(pair AS INT) AS pair, CAST(lag AS INT) AS lag,
  {r('CASE WHEN den > 0 THEN num / den ELSE 0 END')} AS correlation
FROM cc JOIN (SELECT DISTINCT episode_index, n FROM ev) USING (episode_index)
WHERE abs(lag) <= least(30, n // 4) AND n // 4 >= 2""",
    ),
)
def episode_alignment(spark, sf):
    frames = ins.each_episode(ev(spark, sf))
    own = frames.select("dataset").distinct().withColumn("_p", F.explode(F.array(F.lit(0), F.lit(1))))
    own = own.select("dataset", F.col("_p").alias("action_dim"), F.col("_p").alias("state_dim"))
    return rounded(ins.cross_correlation(frames, own, quarter_limit=True), "correlation")


@query(
    "a22_episode_velocity",
    sql(
        EV_LONG
        + """,
rg AS (SELECT episode_index, dim, CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END AS motor_range,
         count(DISTINCT x) <= 4 AS discrete FROM evl GROUP BY 1, 2),
sv AS (SELECT episode_index, dim, count(*) AS steps, stddev_pop(d / motor_range) AS std, max(abs(d)) / max(motor_range) AS max_abs,
         min(d) / max(motor_range) AS lo, max(d) / max(motor_range) AS hi, max(motor_range) AS motor_range, bool_or(discrete) AS discrete,
         list_sort(list(abs(d)))[CAST(floor(count(*) * 0.95) AS INT) + 1] < max(motor_range) * 0.001 AS inactive
       FROM evd JOIN rg USING (episode_index, dim) WHERE d IS NOT NULL GROUP BY 1, 2)""",
        f"""SELECT 'events#' || episode_index AS dataset, CAST(dim AS INT) AS dim, motor_range, discrete, inactive, {r('std')} AS std,
  {r('max_abs')} AS max_abs, {r('lo')} AS lo, {r('hi')} AS hi, steps FROM sv""",
    ),
)
def episode_velocity(spark, sf):
    frames = ins.each_episode(ev(spark, sf))
    ranges = cut(ins.motor_ranges(frames))
    out, _ = ins.velocity_stats(frames, ranges, cut(ins.activity(frames, ranges)))
    return rounded(out, "std", "max_abs", "lo", "hi")


@query(
    "j14_action_state_pairs",
    """WITH a AS (SELECT l_returnflag AS dataset, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) - 1 AS INT) AS dim,
    's' || l_suppkey AS name FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem)),
s AS (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY nm DESC) - 1 AS INT) AS dim,
    CASE WHEN dataset = 'A' THEN 'x' ELSE '' END || nm AS name FROM (SELECT dataset, name AS nm FROM a)),
m AS (SELECT a.dataset, a.dim AS action_dim, min(s.dim) AS state_dim FROM a JOIN s USING (dataset, name) GROUP BY 1, 2)
SELECT * FROM m UNION ALL
SELECT a.dataset, a.dim, a.dim FROM a JOIN s ON a.dataset = s.dataset AND a.dim = s.dim WHERE a.dataset NOT IN (SELECT dataset FROM m)""",
)
def action_state_pairs(spark, sf):
    # A joint per supplier; the states list the same names backwards, and for one
    # dataset under other names.
    ids = li_frames(spark, sf).select("dataset", "episode_index").distinct()
    name = F.concat(F.lit("s"), F.col("episode_index").cast("string"))
    from trajlake.operators.blocks import positions

    a = positions(ids.withColumn("name", name), ["episode_index"], F.col("episode_index"), ["dataset"], "dim")
    a = a.select("dataset", F.col("dim").cast("int").alias("dim"), "name")
    s = positions(a.drop("dim"), [F.desc("name")], F.lit(0), ["dataset"], "dim")
    other = F.when(F.col("dataset") == "A", F.concat(F.lit("x"), F.col("name"))).otherwise(F.col("name"))
    s = s.select("dataset", F.col("dim").cast("int").alias("dim"), other.alias("name"))
    return ins.pair_dims(a, s)


LEN = LI + """,
ln AS (SELECT dataset, episode_index, count(*) AS n, floor(count(*) / 7.0 * 100 + 0.5) / 100 AS s FROM li GROUP BY 1, 2)"""


def lengths(spark, sf):
    return ep.lengths_in_seconds(episode_lengths(li_frames(spark, sf)), F.lit(7.0))


@query(
    "a06_length_stats",
    sql(
        LEN
        + """,
m AS (SELECT dataset, count(*) AS episodes, floor(avg(s) * 100 + 0.5) / 100 AS mean, min(s) AS lo, max(s) AS hi,
        list_sort(list(s)) AS l FROM ln GROUP BY 1)""",
        """SELECT dataset, episodes, mean, floor((l[(episodes - 1) // 2 + 1] + l[episodes // 2 + 1]) / 2 * 100 + 0.5) / 100 AS median,
  (SELECT floor(sqrt(avg((s - mean) ** 2)) * 100 + 0.5) / 100 FROM ln WHERE ln.dataset = m.dataset) AS std, lo AS shortest, hi AS longest
FROM m""",
    ),
)
def length_stats(spark, sf):
    return ep.length_stats(lengths(spark, sf))


@query(
    "a07_frame_length_stats",
    sql(
        LEN,
        f"""SELECT dataset, count(*) AS episodes, min(n) AS shortest, max(n) AS longest, {r('avg(n)')} AS mean, {r('stddev_pop(n)')} AS std,
  median(n) AS median, {r('min(n) / 7.0')} AS shortest_seconds, {r('max(n) / 7.0')} AS longest_seconds, {r('avg(n) / 7.0')} AS mean_seconds
FROM ln GROUP BY 1""",
    ),
)
def frame_length_stats(spark, sf):
    out = ep.frame_length_stats(episode_lengths(li_frames(spark, sf)), F.lit(7.0))
    return rounded(out, "mean", "std", "shortest_seconds", "longest_seconds", "mean_seconds")


HIST = LEN + """,
e AS (SELECT dataset, count(*) AS c, list_sort(list(s)) AS l FROM ln GROUP BY 1),
p AS (SELECT *, l[CAST(floor(c * 0.01) AS INT) + 1] AS p1, l[CAST(ceil(c * 0.99) AS INT)] AS p99 FROM e),
w0 AS (SELECT *, CASE WHEN p99 = p1 THEN 1 ELSE p99 - p1 END / greatest(10.0, least(50.0, ceil(log2(c) + 1))) AS raw FROM p),
w1 AS (SELECT *, pow(10, floor(log10(raw))) AS mag FROM w0),
w2 AS (SELECT *, CASE WHEN mag >= raw THEN mag WHEN 2 * mag >= raw THEN 2 * mag WHEN 2.5 * mag >= raw THEN 2.5 * mag
         WHEN 5 * mag >= raw THEN 5 * mag WHEN 10 * mag >= raw THEN 10 * mag ELSE raw END AS width FROM w1),
h AS (SELECT dataset, floor(p1 / width) * width AS minimum, width,
        CAST(greatest(1, floor((ceil(p99 / width) * width - floor(p1 / width) * width) / width + 0.5)) AS INT) AS bins FROM w2),
bn AS (SELECT ln.dataset, episode_index, CAST(greatest(0, least(bins - 1, floor((s - minimum) / width))) AS INT) AS bin
       FROM ln JOIN h USING (dataset)),
ev_ AS (SELECT dataset, minimum, width, CAST(unnest(range(0, bins)) AS INT) AS bin FROM h)"""


@query(
    "a08_length_histogram",
    sql(
        HIST,
        f"""SELECT dataset, bin, {r('minimum + bin * width')} AS low, {r('minimum + bin * width + width')} AS high,
  (SELECT count(*) FROM bn WHERE bn.dataset = ev_.dataset AND bn.bin = ev_.bin) AS episodes FROM ev_""",
    ),
)
def length_histogram(spark, sf):
    df = lengths(spark, sf)
    return rounded(ep.histogram(df, ep.histogram_bins(df)), "low", "high")


@query(
    "a09_bin_members",
    sql(
        HIST,
        """SELECT ev_.dataset, ev_.bin, episode_index, CASE WHEN episode_index IS NOT NULL THEN
  row_number() OVER (PARTITION BY ev_.dataset, ev_.bin ORDER BY episode_index) - 1 END AS place
FROM ev_ LEFT JOIN bn ON bn.dataset = ev_.dataset AND bn.bin = ev_.bin""",
    ),
)
def bin_members(spark, sf):
    df = lengths(spark, sf)
    return ep.bin_members(df, ep.histogram_bins(df))


@query(
    "t01_length_extremes",
    sql(
        LEN
        + """,
a AS (SELECT dataset, 'shortest' AS side, CAST(row_number() OVER (PARTITION BY dataset ORDER BY s, episode_index) AS INT) AS rank,
        episode_index, s AS seconds FROM ln),
b AS (SELECT dataset, 'longest' AS side, CAST(row_number() OVER (PARTITION BY dataset ORDER BY s DESC, episode_index DESC) AS INT) AS rank,
        episode_index, s AS seconds FROM ln)""",
        "SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank <= 5",
    ),
)
def length_extremes(spark, sf):
    return ep.extremes(lengths(spark, sf))


@query("p13_length_range", sql(LEN, "SELECT dataset, episode_index, s AS seconds FROM ln WHERE s < 27 OR s > 30"))
def length_range(spark, sf):
    return ep.outside_range(lengths(spark, sf), 27, 30).select(*KEYS, "seconds")


@query(
    "p08_episode_scope",
    sql(
        LI
        + """, ids AS (SELECT dataset, episode_index, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY episode_index) AS rk
  FROM li GROUP BY 1, 2)""",
        """SELECT dataset, episode_index, n, 'first' AS rule FROM ids WHERE rk <= 7
UNION ALL SELECT dataset, episode_index, n, 'range' FROM ids WHERE episode_index BETWEEN 3 AND 8""",
    ),
)
def episode_scope(spark, sf):
    df = episode_lengths(li_frames(spark, sf))
    first = ep.scope(df, first=7).withColumn("rule", F.lit("first"))
    return first.unionByName(ep.scope(df, first=2, between=(3, 8)).withColumn("rule", F.lit("range")))


@query(
    "p09_even_sample",
    sql(
        EV
        + """,
pk AS (SELECT DISTINCT episode_index, CAST(floor(i * (n - 1) / 19.0 + 0.5) AS BIGINT) AS position
       FROM (SELECT DISTINCT episode_index, n FROM ev), (SELECT unnest(range(0, 20)) AS i) WHERE n > 20)""",
        """SELECT dataset, episode_index, position, value FROM ev JOIN pk USING (episode_index, position)
UNION ALL SELECT dataset, episode_index, position, value FROM ev WHERE n <= 20""",
    ),
)
def even_sample(spark, sf):
    frames = ev_frames(spark, sf)
    return ep.even_sample(frames, 20).select(*KEYS, "position", F.col("action")[0].alias("value"))


@query(
    "p17_episode_list",
    sql(
        EV + ", big AS (SELECT episode_index FROM ev GROUP BY 1 HAVING max(value) > 400)",
        f"""SELECT dataset, episode_index, count(*) AS n, {r('sum(value)', 4)} AS total FROM ev
WHERE episode_index IN (SELECT episode_index FROM big) GROUP BY 1, 2""",
    ),
)
def episode_list(spark, sf):
    frames = ev_frames(spark, sf)
    chosen = frames.groupBy(*KEYS).agg(F.max(F.col("action")[0]).alias("m")).where("m > 400")
    out = ep.only(frames, chosen).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum(F.col("action")[0]).alias("total")
    )
    return rounded(out, "total", digits=4)


@query(
    "w17_normalised_time",
    sql(
        EV + ", du AS (SELECT episode_index, max(t) AS duration FROM ev GROUP BY 1)",
        f"""SELECT dataset, episode_index, position, {r('position / greatest(n - 1, 1) * duration')} AS display_time
FROM ev JOIN du USING (episode_index)""",
    ),
)
def normalised_time(spark, sf):
    frames = ev_frames(spark, sf)
    durations = frames.groupBy(*KEYS).agg(F.max("timestamp").alias("duration"))
    out = ep.normalised_time(frames, durations)
    return rounded(out.select(*KEYS, "position", "display_time"), "display_time")


@query(
    "f29_episode_duration",
    sql(
        EV,
        f"""SELECT dataset, episode_index, {r('CASE WHEN episode_index % 2 = 0 THEN count(*) / 30.0 ELSE max(t) - min(t) END')} AS duration
FROM ev GROUP BY 1, 2""",
    ),
)
def episode_duration(spark, sf):
    frames = ev_frames(spark, sf)
    per = frames.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")
    )
    fps = F.when(F.col("episode_index") % 2 == 0, F.lit(30.0)).otherwise(F.lit(0.0))
    out = per.withColumn("duration", ep.duration(F.col("n"), fps, F.col("a"), F.col("b")))
    return rounded(out.select(*KEYS, "duration"), "duration")

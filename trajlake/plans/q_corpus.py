"""Queries over the dataset catalogue, its history and its tags."""

from pyspark.sql import functions as F

from trajlake.operators import corpus
from trajlake.operators import episodes as ep
from trajlake.operators.blocks import KEYS, episode_lengths
from trajlake.plans.oracle import CATALOG, LI, SNAP, r, sql
from trajlake.plans.q_stats import rounded
from trajlake.plans.registry import query
from trajlake.plans.views import catalog, day_snapshots, li_frames, table
from trajlake.session import cut

GROUPS = """SELECT prefix, count(*) AS tasks, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status = 'incomplete') AS incomplete, CAST(sum(total_episodes) AS BIGINT) AS episodes,
  CAST(sum(total_frames) AS BIGINT) AS frames, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM catalog GROUP BY 1"""


@query("a23_group_by_prefix", sql(CATALOG, GROUPS))
def by_prefix(spark, sf):
    return corpus.group_by_prefix(catalog(spark, sf))


SEG = """,
seg AS (SELECT prefix, count(*) AS tasks, sum(hours) AS hours, CAST(sum(total_episodes) AS BIGINT) AS episodes,
          CAST(sum(total_frames) AS BIGINT) AS frames, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM catalog GROUP BY 1)"""


@query(
    "a24_corpus_stats",
    sql(
        CATALOG + SEG,
        f"""SELECT prefix, tasks, {r('hours')} AS hours, episodes, frames, bytes, {r('hours / sum(hours) OVER ()')} AS share,
  {r('CASE WHEN episodes > 0 THEN hours * 3600 / episodes END')} AS episode_seconds FROM seg""",
    ),
)
def corpus_stats(spark, sf):
    return rounded(corpus.corpus_stats(catalog(spark, sf)), "hours", "share", "episode_seconds")


@query(
    "a24_corpus_totals",
    sql(
        CATALOG + SEG,
        f"""SELECT prefix, CAST(sum(tasks) AS BIGINT) AS tasks, {r('sum(hours)')} AS hours, CAST(sum(episodes) AS BIGINT) AS episodes,
  CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes FROM seg GROUP BY ROLLUP (prefix)""",
    ),
)
def corpus_totals(spark, sf):
    return rounded(corpus.corpus_totals(corpus.corpus_stats(catalog(spark, sf))), "hours")


@query("w15_share_of_total", sql(CATALOG + SEG, f"SELECT prefix, {r('hours / sum(hours) OVER ()')} AS share FROM seg"))
def share_of_total(spark, sf):
    return rounded(corpus.corpus_stats(catalog(spark, sf)).select("prefix", "share"), "share")


@query(
    "a25_health_counts",
    sql(
        CATALOG,
        """SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status <> 'ok') AS issues FROM catalog""",
    ),
)
def health_counts(spark, sf):
    return corpus.health_counts(catalog(spark, sf))


@query("a25_tag_counts", sql(CATALOG, "SELECT task, count(*) AS datasets FROM catalog GROUP BY 1"))
def tag_counts(spark, sf):
    return corpus.tag_counts(catalog(spark, sf))


@query("a25_robots", sql(CATALOG, "SELECT DISTINCT robot_type FROM catalog"))
def robots(spark, sf):
    return corpus.robots(catalog(spark, sf))


@query(
    "t04_dataset_ranking",
    sql(
        CATALOG,
        """SELECT prefix, path, size_bytes, total_frames, total_episodes,
  row_number() OVER (PARTITION BY prefix ORDER BY size_bytes DESC, total_frames DESC, total_episodes DESC, path) - 1 AS rank FROM catalog""",
    ),
)
def dataset_ranking(spark, sf):
    out = corpus.rank_datasets(catalog(spark, sf))
    return out.select("prefix", "path", "size_bytes", "total_frames", "total_episodes", "rank")


@query("t04_group_ranking", sql(CATALOG, f"SELECT * FROM ({GROUPS}) ORDER BY bytes DESC, frames DESC, episodes DESC, prefix"))
def group_ranking(spark, sf):
    return corpus.rank_groups(corpus.group_by_prefix(catalog(spark, sf)))


@query("t05_segments_by_hours", sql(CATALOG + SEG, f"SELECT prefix, {r('hours')} AS hours FROM seg ORDER BY hours DESC, prefix"))
def segments_by_hours(spark, sf):
    out = rounded(corpus.corpus_stats(catalog(spark, sf)).select("prefix", "hours"), "hours")
    return corpus.rank_segments(out)


@query("f05_prefix_and_task", sql(CATALOG, "SELECT path, prefix, task_name FROM catalog"))
def prefix_and_task(spark, sf):
    return catalog(spark, sf).select(
        "path", corpus.prefix(F.col("path")).alias("prefix"), corpus.task_name(F.col("path")).alias("task_name")
    )


@query("f07_health", sql(CATALOG, "SELECT path, status FROM catalog"))
def health(spark, sf):
    return catalog(spark, sf).select(
        "path",
        corpus.health(F.col("total_episodes"), F.col("has_data"), F.col("has_videos")).alias("status"),
    )


@query(
    "p10_dataset_filter",
    sql(
        CATALOG,
        """SELECT 'robot+issues' AS rule, path FROM catalog WHERE robot_type = 'BUILDING' AND status <> 'ok'
UNION ALL SELECT 'untagged', path FROM catalog WHERE task IS NULL AND status = 'ok'
UNION ALL SELECT 'text', path FROM catalog WHERE task = 'nation_3' AND
  (contains(lower(path), '1') OR contains(lower(robot_type), '1') OR contains(task, '1') OR contains(scene, '1') OR contains(object, '1'))
UNION ALL SELECT 'object', path FROM catalog WHERE contains(lower(path), 'j_2') OR contains(lower(robot_type), 'j_2')
  OR contains(coalesce(task, ''), 'j_2') OR contains(scene, 'j_2') OR contains(object, 'j_2')
UNION ALL SELECT 'groups', prefix FROM catalog WHERE contains(lower(path), 'nation_7') GROUP BY prefix""",
    ),
)
def dataset_filter(spark, sf):
    c = catalog(spark, sf)
    parts = {
        "robot+issues": corpus.select_datasets(c, robot="BUILDING", status="issues"),
        "untagged": corpus.select_datasets(c, status="ok", untagged=True),
        "text": corpus.select_datasets(c, task="nation_3", text=" 1 "),
        "object": corpus.select_datasets(c, text="J_2"),
        "groups": corpus.select_groups(c, "Nation_7").withColumnRenamed("prefix", "path"),
    }
    out = None
    for rule, df in parts.items():
        part = df.select(F.lit(rule).alias("rule"), "path")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j19_tag_overrides",
    sql(
        CATALOG,
        """SELECT path, CASE WHEN total_episodes > 12 THEN 'busy' ELSE task END AS task,
  CASE WHEN total_episodes > 12 THEN NULL ELSE scene END AS scene FROM catalog WHERE status <> 'empty'""",
    ),
)
def tag_overrides(spark, sf):
    c = catalog(spark, sf)
    new = c.where("total_episodes > 12").select(
        "path", F.lit("busy").alias("task"), F.lit(None).cast("string").alias("scene")
    )
    return corpus.with_tag_overrides(c, new, c.where("status = 'empty'")).select("path", "task", "scene")


@query(
    "f23_day_snapshots",
    sql(SNAP, "SELECT day, source, tasks, episodes, frames, hours, bytes FROM snap"),
)
def snapshots(spark, sf):
    return day_snapshots(spark, sf)


@query(
    "s20_snapshot_store",
    sql(
        SNAP
        + """,
lastday AS (SELECT max(day) AS day FROM snap),
merged AS (SELECT * FROM snap WHERE day <> (SELECT day FROM lastday)
  UNION ALL SELECT day, source, tasks + 1, episodes, frames, hours, bytes FROM snap WHERE day = (SELECT day FROM lastday))""",
        "SELECT day, source, tasks, episodes, frames, hours, bytes FROM merged",
    ),
)
def snapshot_store(spark, sf):
    history = cut(day_snapshots(spark, sf))
    # Malformed days go: every first-of-month row again, under a day that is none.
    bad = history.where(F.col("day").endswith("-01")).withColumn("day", F.lit("yesterday"))
    last = history.agg(F.max("day")).scalar()
    today = history.where(F.col("day") == last).withColumn("tasks", F.col("tasks") + 1)
    return corpus.record_day(history.unionByName(bad), today)


@query(
    "w16_previous_day",
    sql(
        SNAP,
        """SELECT day, lag(day) OVER (ORDER BY day) AS since,
  CAST(date_diff('day', CAST(lag(day) OVER (ORDER BY day) AS DATE), CAST(day AS DATE)) AS INT) AS span_days
FROM (SELECT DISTINCT day FROM snap)""",
    ),
)
def previous_day(spark, sf):
    return corpus.previous_days(day_snapshots(spark, sf))


GROWTH = """,
dl AS (SELECT day, lag(day) OVER (ORDER BY day) AS since FROM (SELECT DISTINCT day FROM snap)),
lk AS (SELECT *, CAST(date_diff('day', CAST(since AS DATE), CAST(day AS DATE)) AS INT) AS span_days FROM dl WHERE since IS NOT NULL),
nw AS (SELECT lk.day, since, span_days, source, tasks, episodes, frames, hours, bytes FROM lk JOIN snap ON snap.day = lk.day),
od AS (SELECT lk.day, since, span_days, source, tasks, episodes, frames, hours, bytes FROM lk JOIN snap ON snap.day = lk.since),
gr AS (SELECT coalesce(nw.day, od.day) AS day, coalesce(nw.since, od.since) AS since, coalesce(nw.span_days, od.span_days) AS span_days,
         coalesce(nw.source, od.source) AS source, coalesce(nw.tasks, 0) - coalesce(od.tasks, 0) AS tasks,
         coalesce(nw.episodes, 0) - coalesce(od.episodes, 0) AS episodes, coalesce(nw.frames, 0) - coalesce(od.frames, 0) AS frames,
         coalesce(nw.hours, 0) - coalesce(od.hours, 0) AS hours,
         CASE WHEN od.day IS NULL THEN nw.bytes ELSE coalesce(nw.bytes, 0) - od.bytes END AS bytes
       FROM nw FULL JOIN od ON nw.day = od.day AND nw.source = od.source)"""


@query("j16_snapshot_diff", sql(SNAP + GROWTH, f"SELECT day, since, span_days, source, tasks, episodes, frames, {r('hours', 3)} AS hours, bytes FROM gr"))
def snapshot_diff(spark, sf):
    return rounded(corpus.daily_growth(cut(day_snapshots(spark, sf))), "hours", digits=3)


@query(
    "u03_sources_of_two_days",
    sql(SNAP + GROWTH, "SELECT day, count(DISTINCT source) AS sources FROM gr GROUP BY 1"),
)
def sources_of_two_days(spark, sf):
    growth = corpus.daily_growth(cut(day_snapshots(spark, sf)))
    return growth.groupBy("day").agg(F.count_distinct("source").alias("sources"))


FLAT = """tasks = 0 AND episodes = 0 AND frames = 0 AND abs(hours) < 0.005 AND (bytes IS NULL OR bytes = 0)"""


@query(
    "f22_growth_totals",
    sql(
        SNAP + GROWTH + """,
tt AS (SELECT day, since, span_days, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(episodes) AS BIGINT) AS episodes,
  CAST(sum(frames) AS BIGINT) AS frames, sum(hours) AS hours,
  CASE WHEN count(*) FILTER (bytes IS NULL) = 0 THEN CAST(sum(bytes) AS BIGINT) END AS bytes FROM gr GROUP BY 1, 2, 3)""",
        f"SELECT day, since, span_days, tasks, episodes, frames, {r('hours', 3)} AS hours, bytes, ({FLAT}) AS flat FROM tt",
    ),
)
def growth_totals(spark, sf):
    out = corpus.growth_totals(corpus.daily_growth(cut(day_snapshots(spark, sf))))
    return rounded(out.withColumn("flat", corpus.is_flat()), "hours", digits=3)


@query(
    "f21_day_key",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1",
)
def day_key(spark, sf):
    return table(spark, sf, "events").groupBy(corpus.day_key(F.col("ts")).alias("day")).agg(
        F.count("*").alias("events")
    )


@query(
    "j23_manifest_check",
    sql(
        CATALOG
        + """,
inv AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, 'data/' || o_orderkey || '.parquet' AS path,
          CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
man AS (SELECT dataset, path, CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P' THEN size + 1 ELSE size END AS size
        FROM orders o JOIN inv ON inv.path = 'data/' || o.o_orderkey || '.parquet')""",
        """SELECT CAST(c_custkey AS VARCHAR) AS dataset, coalesce(listed, 0) AS listed, coalesce(ok, false) AS current
FROM customer LEFT JOIN (SELECT man.dataset, count(*) AS listed, bool_and(inv.size IS NOT NULL AND inv.size = man.size) AS ok
  FROM man LEFT JOIN inv ON inv.dataset = man.dataset AND inv.path = man.path GROUP BY 1) m ON m.dataset = CAST(c_custkey AS VARCHAR)""",
    ),
)
def manifest_check(spark, sf):
    # Orders as the files of a customer's dataset; some are listed at another size.
    orders = table(spark, sf, "orders")
    files = orders.select(
        F.col("o_custkey").cast("string").alias("dataset"),
        F.concat(F.lit("data/"), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("path"),
        F.round("o_totalprice").cast("long").alias("size"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("off"),
    )
    manifest = files.withColumn("size", F.col("size") + F.col("off").cast("long"))
    sets = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset"))
    return corpus.manifest_state(manifest.drop("off"), files.drop("off"), sets)


@query(
    "a29_inventory_totals",
    """WITH inv AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, CASE WHEN o_orderpriority = '5-LOW' THEN 'meta/' ELSE 'data/' END || o_orderkey ||
    CASE WHEN o_orderstatus = 'P' THEN '.bin' ELSE '.parquet' END AS path, CAST(round(o_totalprice) AS BIGINT) AS size,
    o_orderstatus = 'O' AS symlink, o_totalprice > 1000 AS readable FROM orders)
SELECT dataset, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (symlink) AS symlinks, count(*) FILTER (NOT readable) AS unreadable,
  count(*) FILTER (starts_with(path, 'data/') AND NOT ends_with(path, '.parquet')) AS not_parquet, count(*) FILTER (size > 400000) AS large_files
FROM inv GROUP BY 1""",
)
def inventory_totals(spark, sf):
    o = table(spark, sf, "orders")
    folder = F.when(F.col("o_orderpriority") == "5-LOW", "meta/").otherwise("data/")
    ending = F.when(F.col("o_orderstatus") == "P", ".bin").otherwise(".parquet")
    inventory = o.select(
        F.col("o_custkey").cast("string").alias("dataset"),
        F.concat(folder, F.col("o_orderkey").cast("string"), ending).alias("path"),
        F.round("o_totalprice").cast("long").alias("size"),
        (F.col("o_orderstatus") == "O").alias("symlink"),
        (F.col("o_totalprice") > 1000).alias("readable"),
    )
    return corpus.inventory_totals(inventory, large=400_000)


@query(
    "j18_flagged_view",
    sql(
        LI + ", fl AS (SELECT dataset, episode_index FROM li GROUP BY 1, 2 HAVING max(price) > 104000 OR min(n) < 190)",
        f"SELECT dataset, episode_index, count(*) AS n FROM li JOIN fl USING (dataset, episode_index) GROUP BY 1, 2",
    ),
)
def flagged_view(spark, sf):
    frames = li_frames(spark, sf)
    price = frames.groupBy(*KEYS).agg(F.max(F.col("`observation.state`")[0]).alias("m")).where("m > 104000")
    short = episode_lengths(frames).where("n < 190")
    return episode_lengths(ep.only(frames, corpus.flag(price, short)))


@query(
    "u07_without_flagged",
    sql(
        LI + ", fl AS (SELECT dataset, episode_index FROM li GROUP BY 1, 2 HAVING max(price) > 104000)",
        f"""SELECT dataset, count(*) AS frames, {r('avg(q)')} AS mean FROM li
WHERE (dataset, episode_index) NOT IN (SELECT (dataset, episode_index) FROM fl) GROUP BY 1""",
    ),
)
def without_flagged(spark, sf):
    frames = li_frames(spark, sf)
    bad = frames.groupBy(*KEYS).agg(F.max(F.col("`observation.state`")[0]).alias("m")).where("m > 104000")
    out = ep.without(frames, bad).groupBy("dataset").agg(
        F.count("*").alias("frames"), F.avg(F.col("action")[0]).alias("mean")
    )
    return rounded(out, "mean")

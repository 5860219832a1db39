"""Shared SQL for the oracles: the trajectory views as CTEs, and rounding."""

EV = """
ev0 AS (
  SELECT 'events' AS dataset, user_id AS episode_index, event_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position
  FROM events),
ev AS (
  SELECT *, (us - min(us) OVER (PARTITION BY episode_index)) / 1e6 AS t,
         coalesce(lead(value) OVER (PARTITION BY episode_index ORDER BY position), value) AS s0,
         count(*) OVER (PARTITION BY episode_index) AS n,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
              WHEN 'signup' THEN 3 ELSE 4 END AS task_index
  FROM ev0)"""

EV_LONG = (
    EV
    + """,
evl AS (
  SELECT dataset, episode_index, position, n, t, 0 AS dim, value AS x, s0 AS s FROM ev
  UNION ALL
  SELECT dataset, episode_index, position, n, t, 1 AS dim, k AS x, k AS s FROM ev),
evd AS (
  SELECT *, x - lag(x) OVER (PARTITION BY episode_index, dim ORDER BY position) AS d,
         s - lag(s) OVER (PARTITION BY episode_index, dim ORDER BY position) AS ds
  FROM evl)"""
)

LI = """
li AS (
  SELECT l_returnflag AS dataset, l_suppkey AS episode_index, l_orderkey AS index,
         l_quantity AS q, l_discount AS dc, l_tax AS tx, l_extendedprice AS price,
         l_linenumber % 3 AS task_index,
         row_number() OVER w - 1 AS position,
         count(*) OVER (PARTITION BY l_returnflag, l_suppkey) AS n
  FROM lineitem
  WINDOW w AS (PARTITION BY l_returnflag, l_suppkey
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                        l_quantity, l_discount, l_tax))"""

LI_LONG = (
    LI
    + """,
lil AS (
  SELECT dataset, episode_index, position, n, 0 AS dim, q AS x FROM li
  UNION ALL SELECT dataset, episode_index, position, n, 1, dc FROM li
  UNION ALL SELECT dataset, episode_index, position, n, 2, tx FROM li),
lid AS (
  SELECT *, lag(x) OVER (PARTITION BY dataset, episode_index, dim ORDER BY position) AS p,
         x - lag(x) OVER (PARTITION BY dataset, episode_index, dim ORDER BY position) AS d
  FROM lil),
lis AS (
  SELECT dataset, dim, CASE WHEN min(d) = max(d) THEN 1.0 ELSE coalesce(nullif(stddev_pop(d), 0), 1.0) END AS scale
  FROM lid WHERE d IS NOT NULL GROUP BY dataset, dim),
liz AS (
  SELECT lid.*, abs(d / scale) AS z FROM lid JOIN lis USING (dataset, dim) WHERE d IS NOT NULL)"""
)

EMB = """
emb AS (
  SELECT 'embeddings' AS dataset, CAST(label AS BIGINT) AS episode_index, vec_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings)"""


def r(expr: str, digits: int = 6) -> str:
    """Round half up, by the same steps as the library's rule."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"

CATALOG = """
lq AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
po AS (SELECT o_custkey, count(*) AS total_episodes, CAST(sum(coalesce(q, 0)) AS BIGINT) AS total_frames,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes
       FROM orders LEFT JOIN lq ON l_orderkey = o_orderkey GROUP BY 1),
catalog AS (
  SELECT r_name || '/' || n_name || '/' || c_name AS path, c_custkey AS id, c_mktsegment AS robot_type,
         coalesce(total_episodes, 0) AS total_episodes, coalesce(total_frames, 0) AS total_frames,
         CASE WHEN c_acctbal > 9000 THEN 0.0 ELSE 30.0 END AS fps, coalesce(size_bytes, 0) AS size_bytes,
         CASE WHEN total_episodes IS NULL THEN 'empty' WHEN coalesce(total_frames, 0) <= 0 OR c_acctbal <= 0 THEN 'incomplete'
              ELSE 'ok' END AS status,
         CASE WHEN c_acctbal > 2000 THEN lower(n_name) END AS task, lower(r_name) AS scene,
         'obj_' || c_nationkey AS object, r_name AS prefix, n_name || '/' || c_name AS task_name,
         CASE WHEN coalesce(total_frames, 0) > 0 AND c_acctbal <= 9000 THEN total_frames / 30.0 / 3600.0 ELSE 0.0 END AS hours
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN po ON o_custkey = c_custkey)"""

SNAP = """
snap AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS source, count(DISTINCT o_custkey) AS tasks,
           count(*) AS episodes, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS frames,
           floor(sum(CAST(round(o_totalprice) AS BIGINT)) / 30.0 / 3600.0 * 1000 + 0.5) / 1000 AS hours,
           CASE WHEN min(o_orderstatus) <> 'F' THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) END AS bytes
         FROM orders GROUP BY 1, 2)"""

DIRTY = LI_LONG.replace(
    "SELECT dataset, episode_index, position, n, 0 AS dim, q AS x FROM li\n  UNION ALL SELECT dataset, episode_index, position, n, 1, dc FROM li\n  UNION ALL SELECT dataset, episode_index, position, n, 2, tx FROM li",
    "SELECT dataset, episode_index, position, n, 0 AS dim, CASE WHEN q = 50 AND dc = 0.1 THEN 1000 ELSE q END AS x FROM li",
)

ORD = """
od0 AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, o_orderkey AS episode_index, o_orderstatus AS st, o_orderpriority AS pr,
          l_quantity AS q, l_discount AS dc, l_extendedprice AS price, l_tax AS tx, l_linenumber % 3 AS task_index,
          row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                             l_quantity, l_discount, l_tax) - 1 AS position
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
oe AS (SELECT dataset, episode_index, st, pr, count(*) AS n, count(*) + CASE WHEN pr = '2-HIGH' AND st = 'O' THEN 1 ELSE 0 END AS length
       FROM od0 GROUP BY 1, 2, 3, 4),
oi AS (SELECT dataset, count(*) AS eps, CAST(sum(n) AS BIGINT) AS frames, any_value(c_acctbal) AS bal, any_value(c_mktsegment) AS seg,
         min(n) AS shortest, bool_or(pr = '1-URGENT') AS has_meta
       FROM oe JOIN customer ON CAST(c_custkey AS VARCHAR) = dataset GROUP BY 1),
inv AS (SELECT dataset, 'data/chunk-000/file-' || CASE WHEN episode_index < 1000 THEN lpad(CAST(episode_index AS VARCHAR), 3, '0') ELSE CAST(episode_index AS VARCHAR) END || '.parquet' AS path, length * 1000 AS size FROM oe
        UNION ALL SELECT dataset, 'videos/observation.images.top/chunk-' || lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0') || '/file-' ||
          CASE WHEN episode_index < 1000 THEN lpad(CAST(episode_index AS VARCHAR), 3, '0') ELSE CAST(episode_index AS VARCHAR) END || '.mp4', length * 10000 FROM oe WHERE pr <> '5-LOW'
        UNION ALL SELECT dataset, 'meta/episodes/chunk-000/file-000.parquet', 100 FROM oi WHERE has_meta)"""

"""Queries over pose and gripper velocities, speed limits and joint units."""

from pyspark.sql import functions as F

from trajlake.functions.numbers import round_half_up
from trajlake.functions.vectors import to_radians, unit
from trajlake.operators import motion
from trajlake.operators.blocks import KEYS
from trajlake.plans.oracle import EMB, EV, r, sql
from trajlake.plans.q_stats import rounded
from trajlake.plans.registry import query
from trajlake.plans.views import emb_frames, ev_frames, pose_names


def rates(spark):
    return spark.createDataFrame([("embeddings", 10.0)], "dataset string, fps double")


def _turn_sql() -> str:
    """Gram-Schmidt and the rotation logarithm in SQL (general angles)."""
    v = ", ".join(f"CAST(embedding[{i + 4}] AS DOUBLE) AS v{i}" for i in range(6))
    parts = [
        f"g0 AS (SELECT episode_index, position, {v} FROM emb)",
        "g1 AS (SELECT *, v0 / l AS a0, v1 / l AS a1, v2 / l AS a2 FROM "
        "(SELECT *, sqrt(v0*v0 + v1*v1 + v2*v2) AS l FROM g0))",
        "g2 AS (SELECT *, v3 - p*a0 AS h0, v4 - p*a1 AS h1, v5 - p*a2 AS h2 FROM "
        "(SELECT *, a0*v3 + a1*v4 + a2*v5 AS p FROM g1))",
        "g3 AS (SELECT *, h0 / k AS b0, h1 / k AS b1, h2 / k AS b2 FROM "
        "(SELECT *, sqrt(h0*h0 + h1*h1 + h2*h2) AS k FROM g2))",
        "g4 AS (SELECT *, a1*b2 - a2*b1 AS c0, a2*b0 - a0*b2 AS c1, a0*b1 - a1*b0 AS c2 FROM g3)",
        "g5 AS (SELECT q.episode_index, q.position, "
        + ", ".join(
            f"q.a{i}*w.a{j} + q.b{i}*w.b{j} + q.c{i}*w.c{j} AS m{i}{j}" for i in range(3) for j in range(3)
        )
        + " FROM g4 q JOIN g4 w ON q.episode_index = w.episode_index AND w.position = q.position - 1)",
        "g6 AS (SELECT *, acos(greatest(-1, least(1, (m00 + m11 + m22 - 1) / 2))) AS th FROM g5)",
        "tr AS (SELECT episode_index, position, "
        "(m21 - m12) * th / (2 * sin(th)) AS x, (m02 - m20) * th / (2 * sin(th)) AS y, (m10 - m01) * th / (2 * sin(th)) AS z FROM g6)",
    ]
    return EMB + ",\n" + ",\n".join(parts)


VEL = (
    _turn_sql()
    + """,
ln AS (SELECT *, (CAST(embedding[1] AS DOUBLE) - lag(CAST(embedding[1] AS DOUBLE)) OVER w) / (position / 10.0 - lag(position / 10.0) OVER w) AS vx,
  (CAST(embedding[2] AS DOUBLE) - lag(CAST(embedding[2] AS DOUBLE)) OVER w) / (position / 10.0 - lag(position / 10.0) OVER w) AS vy,
  (CAST(embedding[3] AS DOUBLE) - lag(CAST(embedding[3] AS DOUBLE)) OVER w) / (position / 10.0 - lag(position / 10.0) OVER w) AS vz,
  position / 10.0 - lag(position / 10.0) OVER w AS dt,
  (CAST(embedding[10] AS DOUBLE) - lag(CAST(embedding[10] AS DOUBLE)) OVER w) / (position / 10.0 - lag(position / 10.0) OVER w) AS grip
  FROM emb WINDOW w AS (PARTITION BY episode_index ORDER BY position)),
vl AS (SELECT ln.*, degrees(tr.x) / dt AS wx, degrees(tr.y) / dt AS wy, degrees(tr.z) / dt AS wz
       FROM ln LEFT JOIN tr ON tr.episode_index = ln.episode_index AND tr.position = ln.position)"""
)


def velocity(spark, sf):
    return motion.pose_velocity(emb_frames(spark, sf), "action", pose_names(spark), rates(spark))


@query(
    "w08_linear_velocity",
    sql(
        VEL,
        f"SELECT dataset, episode_index, position, 'left_tcp' AS pose, "
        + ", ".join(f"coalesce({r('v' + a)}, 0) AS v{a}" for a in "xyz")
        + " FROM vl",
    ),
)
def linear_velocity(spark, sf):
    out = velocity(spark, sf).select(*KEYS, "position", "pose", "vx", "vy", "vz")
    return rounded(out, "vx", "vy", "vz")


@query(
    "w09_angular_velocity",
    sql(
        VEL,
        f"SELECT dataset, episode_index, position, 'left_tcp' AS pose, "
        + ", ".join(f"coalesce({r('w' + a, 4)}, 0) AS w{a}" for a in "xyz")
        + " FROM vl",
    ),
)
def angular_velocity(spark, sf):
    out = velocity(spark, sf).select(*KEYS, "position", "pose", "wx", "wy", "wz")
    return rounded(out, "wx", "wy", "wz", digits=4)


@query(
    "w10_gripper_velocity",
    sql(VEL, f"SELECT dataset, episode_index, position, 'left_gripper' AS gripper, coalesce({r('grip')}, 0) AS velocity FROM vl"),
)
def gripper_velocity(spark, sf):
    out = motion.gripper_velocity(emb_frames(spark, sf), "action", pose_names(spark), rates(spark))
    return rounded(out, "velocity")


EVENTS = (
    VEL
    + """,
sc AS (SELECT *, greatest(abs(vx) / 1.5, abs(vy) / 1.5, abs(vz) / 1.5, abs(wx) / 270, abs(wy) / 270, abs(wz) / 270) AS score,
         CAST((abs(vx) > 1.5)::INT + (abs(vy) > 1.5)::INT + (abs(vz) > 1.5)::INT + (abs(wx) > 270)::INT + (abs(wy) > 270)::INT
           + (abs(wz) > 270)::INT AS INT) AS axes FROM vl WHERE position > 0),
hit AS (SELECT * FROM sc WHERE axes > 0)"""
)


@query(
    "w11_speed_limit_events",
    sql(EVENTS, f"SELECT dataset, episode_index, 'left_tcp' AS pose, position, {r('score', 5)} AS score, axes FROM hit"),
)
def speed_limit_events(spark, sf):
    out = motion.speed_events(emb_frames(spark, sf), "action", pose_names(spark), rates(spark))
    return rounded(out, "score", digits=5).select(*KEYS, "pose", "position", "score", F.size("violations").alias("axes"))


@query(
    "t07_worst_speed_events",
    sql(
        EVENTS
        + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY {r('score', 5)} DESC, position) AS rank,
  count(*) OVER (PARTITION BY episode_index) AS events FROM hit)""",
        f"""SELECT dataset, episode_index, 'left_tcp' AS pose, position, {r('score', 5)} AS score, CAST(rank AS INT) AS rank, events,
  greatest(events - 5, 0) AS more FROM rk WHERE rank <= 5""",
    ),
)
def worst_speed_events(spark, sf):
    out = motion.speed_events(emb_frames(spark, sf), "action", pose_names(spark), rates(spark))
    out = rounded(out, "score", digits=5).select(*KEYS, "pose", "position", "score")
    return motion.worst_speed_events(out)


@query(
    "f17_joint_units",
    sql(
        EV,
        f"""SELECT dataset, episode_index, position, CASE WHEN greatest(abs(value * 4), abs(k)) > 360 THEN 'ticks'
    WHEN greatest(abs(value * 4), abs(k)) > 6.3 THEN 'degrees' ELSE 'radians' END AS unit,
  {r('CASE WHEN greatest(abs(value * 4), abs(k)) > 360 THEN (k - 2048) / 2048 * pi() WHEN greatest(abs(value * 4), abs(k)) > 6.3 THEN radians(k) ELSE k END')} AS joint
FROM ev""",
    ),
)
def joint_units(spark, sf):
    v = F.array(F.col("action")[0] * 4, F.col("action")[1])
    return ev_frames(spark, sf).select(
        *KEYS, "position", unit(v).alias("unit"), round_half_up(to_radians(v)[1], 6).alias("joint")
    )

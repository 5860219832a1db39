"""The findings table shared by all checks."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.vectors import field_type, is_numeric_cell
from trajlake.operators import moments, motion_checks, stats
from trajlake.operators.blocks import KEYS, episode_lengths
from trajlake.session import cut
from trajlake.sources.readers import BOOKKEEPING

SEVERITIES = ("PASS", "WARN", "FAIL")
COLUMNS = ("dataset", "check", "severity", "episode_index", "column", "dim", "metric", "value", "message")


@dataclass
class Recording:
    """The tables a check may use; any may hold many datasets."""

    frames: DataFrame
    infos: DataFrame | None = None
    features: DataFrame | None = None
    episodes: DataFrame | None = None
    tasks: DataFrame | None = None
    stored_stats: DataFrame | None = None
    inventory: DataFrame | None = None
    probe: DataFrame | None = None
    names: DataFrame | None = None
    partial: bool = False
    thresholds: dict = field(default_factory=dict)
    _shared: dict = field(default_factory=dict, repr=False)

    def _once(self, key: tuple, build):
        if key not in self._shared:
            self._shared[key] = build()
        return self._shared[key]

    def matrix(self, column: str) -> stats.Matrix:
        """The column's rows, with its episode table found once for all checks."""
        return self._once(("matrix", column), lambda: stats.prepare(self.frames, column))

    def moments(self) -> DataFrame:
        """Moments of every (episode, numeric column, dim), from one pass for all checks."""
        return self._once(("moments",), lambda: cut(moments.moments(self.frames, self.numeric_columns())))

    def summaries(self) -> DataFrame:
        """Summaries of all numeric columns, merged from the moments."""
        return self._once(("summaries",), lambda: cut(moments.merged(moments.of_one_width(self.moments()))))

    def summary(self, column: str) -> DataFrame:
        return self.summaries().where(F.col("column") == column).drop("column")

    def beyond(self) -> DataFrame:
        """Values on the extremes and far from the mean, of all numeric columns, from one pass for all checks."""
        build = lambda: cut(moments.counts_beyond(self.frames, self.moments(), self.summaries(), self.numeric_columns()))
        return self._once(("beyond",), build)

    def scales(self, column: str) -> DataFrame:
        """The column's step std, computed once for all checks."""
        return self._once(("scales", column), lambda: cut(stats.step_scales(self.matrix(column), column)))

    def large_steps(self, column: str) -> DataFrame:
        """The column's scaled steps that a jump check may report, from one pass for all checks."""
        build = lambda: cut(motion_checks.large_steps(self.matrix(column), column, self.scales(column)))
        return self._once(("large_steps", column), build)

    def frozen(self, column: str, share: float) -> DataFrame:
        """Episodes of two rows or more that repeat one value in ``share`` of their rows or more."""

        def build() -> DataFrame:
            runs = motion_checks.longest_frozen_run(self.matrix(column), column)
            return cut(runs.where((F.col("n") >= 2) & (F.col("frozen_share") >= share)))

        return self._once(("frozen", column, share), build)

    def lengths(self) -> DataFrame:
        return self._once(("lengths",), lambda: cut(episode_lengths(self.frames)))

    def datasets(self) -> DataFrame:
        source = self.infos if self.infos is not None else self.lengths()
        return self._once(("datasets",), lambda: cut(source.select("dataset").distinct()))

    def rates(self) -> DataFrame:
        return self.infos.select("dataset", "fps")

    def data_columns(self) -> list[str]:
        own = (*KEYS, *BOOKKEEPING, "position", "file")
        return [c for c in self.frames.columns if c not in own]

    def numeric_columns(self) -> list[str]:
        return [c for c in self.data_columns() if is_numeric_cell(field_type(self.frames, c))]

    def action_columns(self) -> list[str]:
        return action_columns(self.data_columns())

    def signal_columns(self) -> list[str]:
        return signal_columns(self.numeric_columns())


def action_columns(columns: list[str]) -> list[str]:
    """Columns named ``action*``; all data columns where there is none."""
    own = [c for c in columns if c.startswith("action")]
    return own or columns


def signal_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith("action") or "state" in c]


def finding(
    df: DataFrame,
    check: str,
    severity: str | Column,
    metric: str | Column,
    value: Column,
    *message,
    column: str | Column | None = None,
    dim: Column | None = None,
    events: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as findings; ``message`` parts are texts and columns put together.

    ``events`` is the full number of events where a check lists only the worst ones.
    """

    def literal(x, dtype):
        if isinstance(x, str):
            return F.lit(x)
        return F.lit(None).cast(dtype) if x is None else x

    episode = F.col("episode_index") if "episode_index" in df.columns else F.lit(None).cast("long")
    parts = [F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("")) for m in message]
    return df.select(
        "dataset",
        F.lit(check).alias("check"),
        literal(severity, "string").alias("severity"),
        episode.cast("long").alias("episode_index"),
        literal(column, "string").alias("column"),
        literal(dim, "int").cast("int").alias("dim"),
        literal(metric, "string").alias("metric"),
        value.cast("double").alias("value"),
        F.concat(*parts).alias("message"),
        literal(events, "long").cast("long").alias("events"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_pass(found: DataFrame, datasets: DataFrame, check: str) -> DataFrame:
    """Add a PASS row for every dataset the check has nothing against."""
    found = cut(found)  # read twice below
    clean = datasets.join(found.where(F.col("severity") != "PASS").select("dataset").distinct(), "dataset", "left_anti")
    return found.unionByName(
        finding(clean, check, "PASS", "clean", F.lit(None), "nothing found")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "FAIL", 2).when(severity == "WARN", 1).otherwise(0)


def check_summary(findings: DataFrame) -> DataFrame:
    """Worst severity of each check."""
    worst = F.max(severity_rank(F.col("severity")))
    return findings.groupBy("dataset", "check").agg(
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (worst + 1).cast("int")).alias("severity"),
        F.count_if(F.col("severity") != "PASS").alias("findings"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per dataset: the worst severity and how many checks ended in each."""
    checks = check_summary(findings)
    return checks.groupBy("dataset").agg(
        F.when(F.bool_or(F.col("severity") == "FAIL"), "FAIL")
        .when(F.bool_or(F.col("severity") == "WARN"), "WARN")
        .otherwise("PASS")
        .alias("severity"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
    )


def affected_episodes(findings: DataFrame) -> DataFrame:
    """Episodes named by any finding that is not a PASS."""
    return findings.where((F.col("severity") != "PASS") & F.col("episode_index").isNotNull()).select(*KEYS).distinct()

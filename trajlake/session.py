"""Session helpers: tunables read from the session, and tables written between stages."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_KEY = "spark.trajlake.block.rows"
SPLIT_ROWS_KEY = "spark.trajlake.split.rows"

# Rows of one episode that one task sorts in a window.
DEFAULT_BLOCK_ROWS = 65_536
# Rows of one ordering group above which it is sliced before it is numbered.
DEFAULT_SPLIT_ROWS = 1_048_576

_WRITTEN: dict = {}
_LOCAL: dict = {}


@atexit.register
def _clean_local() -> None:
    if "folder" in _LOCAL:
        shutil.rmtree(_LOCAL["folder"], ignore_errors=True)


def block_rows() -> int:
    return int(SparkSession.active().conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def split_rows() -> int:
    return int(SparkSession.active().conf.get(SPLIT_ROWS_KEY, str(DEFAULT_SPLIT_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary
    folder; any other session has none and is told so.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if "folder" not in _LOCAL:
            _LOCAL["folder"] = tempfile.mkdtemp(prefix="trajlake-")
        folder = _LOCAL["folder"]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/trajlake-{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it from there.

    For results that several branches of a plan read, so that none of them
    computes it again, also when executors are lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_once(name: str, source: str, build) -> DataFrame:
    """:func:`cut` of a named table, written once per application."""
    spark = SparkSession.active()
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _WRITTEN:
        df = build()
        path = fresh_path(spark)
        df.write.parquet(path)
        _WRITTEN[key] = (path, df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)

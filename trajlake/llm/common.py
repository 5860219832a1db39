"""Small helpers the text operators share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.session import fresh_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ident(column: str = "doc_id") -> Column:
    return F.col(column).cast("long").alias(column)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that the text operators read; other columns never matter."""
    return docs.select(ident(), whole_text().alias("text"))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


FILE_ROWS = 200_000  # rows of a few numbers that one task may write


def save(df: DataFrame, kind: str, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as zstandard parquet in the shared folder and read it from there.

    ``rows``, where known, is the most rows of a few numbers that ``df`` can have: they are written by
    no more tasks than they need, as a round on few rows would else leave a file for every partition.
    """
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int) -> DataFrame:
    """``table``, marked for broadcast only where it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table

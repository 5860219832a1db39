"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

1. quality: documents that the quality model scores under 0.5 go. The model learns from the
   labels whose crc32(doc_id) mod 3 is not 1, on documents the stage got.
2. near_duplicates: of each class of near copies the document of smallest id stays.
3. personal_data: personal data are replaced by surrogates; n_chars follows the text.
4. mixing: a document appears as often as the mix takes its words, in whole passes: the
   words taken over its size, rounded down, and once more with the chance of the rest (a
   hash of its id decides). A document with no words taken goes.
5. packing: token pieces with sequence and offset.

Nulls, empty texts, repeated rows, empty tables and extra columns are handled as the stage's
operator says. A stage's written copy is needed until the next stage is written.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import dartminhash, gam, mixing, patterns, surrogates
from trajlake.llm.common import save, table
from trajlake.session import fresh_path

END_ID = 2
CAPACITY = 1024
# Texts go to Python some megabytes at a time: batches of 10 000 rows are held in the JVM and in each worker at once.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced, _ = surrogates.replace(docs)
    return replaced.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return patterns.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", packing),
]

# Fitted models, hashed darts and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        for name, stage in STAGES:
            path = fresh_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, held)
    return docs

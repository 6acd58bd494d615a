"""Documents to token shards in five stages. Each stage works on all that the one before it kept.

* ``quality``: rows that the quality classifier scores below its threshold go;
* ``near_duplicates``: of each group of linked fingerprints the row with the smallest id stays;
* ``decontamination``: rows in which a benchmark item occurs go;
* ``mixing``: all rows stay, in mixture order (files and rows of the output follow it);
* ``tokens``: all rows are encoded and written in the order in which the mixture left them, and read back.

All stages but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and
further columns are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, mixing, quality, simhash, tokens
from memlake.llm.queries import QUALITY
from memlake.llm.tables import read, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of at least ``QUALITY``; the model learns from the labels of rows that are not held out."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model, name="__score").where(F.col("__score") >= QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, "doc_id", "text", words=4, radius=4)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def written_order(docs: DataFrame) -> Column | None:
    """Place of each row in the files that ``docs`` was read from; None where it was not read from files."""
    number = lambda pattern: F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("bigint"), F.lit(0))
    place = F.shiftleft(number(r"part-(\d+)"), 44) + F.shiftleft(number(r"[.-]c(\d+)\."), 34) + F.col("_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return None
    return place


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the shard, in the order of the files."""
    shard = tokens.round_trip(docs, TOKENIZER, "doc_id", "text", end_id=1, order=written_order(docs))
    return shard.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontamination", keep_clean), ("mixing", mix), ("tokens", encode)]

# The classifier, the fingerprints and the tokenizer have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Entries that share the most words with a question, from a stored index and with an early stop.

Every shared word counts one, ties go to a stated column. So an entry that holds only m of a question's words scores at most m.
A search scores the entries that hold one of the question's rarest words, which gives a k-th best score s so far. Of its most
frequent words s - 1 then need no look at all: an entry with nothing but those scores less. One word more is
enough for a tie at best, so of its postings only those that win the tie are read. A word that everyone shares
makes no row per question and entry.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, Window as W

from memlake.operators.index import bucket, top
from memlake.session import durable

FIRST = 8  # the rarest words are taken until they promise so many times k entries


class Overlap(NamedTuple):
    """``entries`` (columns given, words), ``postings`` (term, entry, tie) by term bucket, ``vocabulary`` (term, df)."""

    entries: DataFrame
    postings: DataFrame
    vocabulary: DataFrame


def build(entries: DataFrame, entry: str, tie: str, path: str) -> Overlap:
    """Write the index of ``entries``, one row per ``entry`` with its distinct ``words``. Texts are looked at once."""
    spark = entries.sparkSession
    entries.write.parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    post = stored.select(F.explode("words").alias("term"), F.col(entry).alias("entry"), F.col(tie).alias("tie")).withColumn("bucket", bucket(F.col("term")))
    (post.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", F.pmod(F.xxhash64("entry"), F.lit(4)))
     .sortWithinPartitions("bucket", "term", "tie").write.partitionBy("bucket").parquet(f"{path}/postings"))
    post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/vocabulary")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Overlap:
    return Overlap(*[spark.read.parquet(f"{path}/{name}") for name in Overlap._fields])


def most_shared(index: Overlap, questions: DataFrame, key: str, entry: str, tie: str, descending: bool, k: int) -> DataFrame:
    """(key, columns of the entries, overlap, pos): the best ``k`` entries by shared words, then ``tie``, then ``entry``.

    ``questions`` (key, words) hold distinct words. Entries that share nothing are no result; a null list of words asks nothing.
    """
    terms = questions.select(key, F.explode("words").alias("term")).join(index.vocabulary, "term")
    rare = W.partitionBy(key).orderBy("df", "term")
    ranked = (terms.withColumn("rank", F.row_number().over(rare))
              .withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("terms", F.count(F.lit(1)).over(W.partitionBy(key))).withColumn("early", F.col("before") < FIRST * k))
    ranked = durable(ranked.select(key, "term", "rank", "terms", "early").withColumn("bucket", bucket(F.col("term"))))
    asked = questions.select(key, F.col("words").alias("__asked"))
    by = [F.desc("overlap"), F.desc(tie) if descending else F.asc(tie), F.asc(entry)]

    def scored(found: DataFrame) -> DataFrame:
        rows = found.select(key, F.col("entry").alias(entry)).distinct().join(index.entries, entry).join(asked, key)
        return rows.withColumn("overlap", F.size(F.array_intersect("words", "__asked")).cast("bigint")).drop("words", "__asked")

    near = durable(top(scored(ranked.where("early").join(index.postings, ["bucket", "term"])), [key], by, k))
    last = near.where(F.col("pos") == k).select(key, F.col("overlap").alias("__least"), F.col(tie).alias("__tie"))
    # rank r of n words: n - r words are more frequent. With no k-th score yet every word counts.
    open_ = ranked.where("not early").join(last, key, "left").withColumn("__above", F.col("terms") - F.col("rank"))
    open_ = open_.where("__least IS NULL OR __above >= __least - 1")
    wins = (F.col("tie") >= F.col("__tie")) if descending else (F.col("tie") <= F.col("__tie"))
    more = open_.join(index.postings, ["bucket", "term"]).where(F.col("__least").isNull() | (F.col("__above") >= F.col("__least")) | wins)
    rest = scored(more).join(near.select(key, entry), [key, entry], "left_anti")
    return top(near.drop("pos").unionByName(rest), [key], by, k)

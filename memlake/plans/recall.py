"""Hybrid recall of many questions at once: one plan from candidate lists to delivered passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import index as ix, passages as ps, recall as rc
from memlake.plans.settings import Settings
from memlake.session import durable

Judge = Callable[[DataFrame], DataFrame]

# What ranking needs to know of a note; texts are fetched for the candidates that are left.
FACTS = ["doc_id", "uri", "collection", "kind", "identity"]


def askable(questions: DataFrame, max_terms: int) -> DataFrame:
    """Questions that the prompt gate lets through."""
    terms = tx.with_terms(questions, "question", max_terms)
    return terms.where(tx.gate_reason(F.col("question"), F.col("terms")).isNull()).select(questions.columns)


def in_scope(notes: DataFrame, settings: Settings) -> DataFrame:
    """Facts of the notes that the collections and skip paths admit."""
    facts = rc.in_collections(notes.select(FACTS), F.col("collection"), list(settings.collections), list(settings.memory_collections))
    return rc.outside_skip_paths(facts, F.col("uri"), list(settings.skip_paths))


def _again(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positions counted anew after rows were left out."""
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy("pos")).cast("bigint"))


def candidates(lexical: DataFrame, dense: DataFrame, facts: DataFrame, key: str, settings: Settings) -> DataFrame:
    """(key, facts, score, votes, vector_score, pos): fused and gated, mirrors counted as one.

    Notes with one ``identity`` (the same source at the same revision) share their votes; the smallest
    id stands for them. Notes outside the scope leave no gap in a list.
    """
    mine = facts.select("doc_id", "identity")
    lex = _again(lexical.join(mine, "doc_id"), [key, "rung"])
    vec = _again(dense.join(mine, "doc_id"), [key])
    fused = ix.admissible(ix.fuse(lex, vec, [key], "identity", settings.vector_weight, least="doc_id"), settings.vector_gate)
    rows = fused.join(facts.drop("identity"), "doc_id")
    return ix.ranked(rows, [key], [F.desc("score"), F.asc("doc_id")])


def ordered(rows: DataFrame, key: str, settings: Settings, judge: Judge | None) -> DataFrame:
    """Preferred types first, then the judge's order of the top, then the memory slots; ``place`` is the result."""
    if settings.prefer_types:
        rows = rc.prefer(rows, [key], F.col("kind"), list(settings.prefer_types)).drop("pos").withColumnRenamed("place", "pos")
    if judge is not None and settings.rerank_blend > 0:
        head = rows.where(F.col("pos") <= settings.rerank_top)
        rows = rc.rerank(rows, judge(head), [key], "doc_id", settings.rerank_top, settings.rerank_blend)
        rows = rows.select(key, *[c for c in FACTS if c in rows.columns], F.col("place").alias("pos"))
    return rc.slot_order(rows.withColumn("memory", F.col("collection").isin(list(settings.memory_collections))), [key], settings.memory_slots)


def hybrid(questions: DataFrame, lexical: DataFrame, dense: DataFrame, notes: DataFrame, key: str, settings: Settings,
           judge: Judge | None = None) -> DataFrame:
    """(key, place, doc_id, uri, passage, start_char): what is delivered for each question.

    ``lexical`` (key, rung, doc_id, pos) and ``dense`` (key, doc_id, score, pos) are ranked lists; a supplied
    ``judge`` gets the top candidates and gives (key, doc_id, judge). Questions stopped by the prompt gate get
    nothing. Passages are taken in order while they fit ``context_bytes``; one that does not fit
    is passed over for the next.
    """
    asked = askable(questions.select(key, "question"), settings.max_terms)
    open_ = asked.select(key)
    # The pools are short and looked at several times from here on, so they are stored once.
    rows = durable(candidates(lexical.join(open_, key, "left_semi"), dense.join(open_, key, "left_semi"), in_scope(notes, settings), key, settings))
    placed = ordered(rows, key, settings, judge).select(key, "doc_id", F.col("place").alias("slot"))
    texts = placed.join(notes.select("doc_id", "uri", "text"), "doc_id").join(asked, key)
    best = ps.select_passage(texts, [key, "doc_id", "slot", "uri"], "text", "question", settings.snippet_chars, lines=False)
    sized = best.withColumn("size", F.octet_length("passage").cast("bigint"))
    taken = rc.greedy_budget(sized, key, "doc_id", [F.asc("slot")], "size", settings.context_bytes, settings.inject)
    return sized.join(taken.select(key, "doc_id", "place"), [key, "doc_id"]).select(key, "place", "doc_id", "uri", "passage", "start_char")

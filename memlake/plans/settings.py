"""Recall settings and the points where a user plugs in own logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.packs import supported


@dataclass(frozen=True)
class Settings:
    """Defaults of a recall run; ``with_options`` returns a changed copy."""

    collections: tuple[str, ...] = ()
    memory_collections: tuple[str, ...] = ()
    inject: int = 4
    memory_slots: int = 2
    search_n: int = 10
    max_terms: int = 10
    snippet_chars: int = 260
    context_bytes: int = 4096
    skip_paths: tuple[str, ...] = (r"/sessions/",)
    vector_weight: float = 2.0
    vector_gate: float = 0.40
    rerank_top: int = 12
    rerank_blend: float = 0.0
    prefer_types: tuple[str, ...] = ()

    def with_options(self, **options) -> "Settings":
        return replace(self, **options)


# A search backend maps (query_id, rung, query text) to ranked hits (query_id, rung, doc_id, pos).
SearchBackend = Callable[[DataFrame], DataFrame]


def search_with(backend: SearchBackend, rungs: DataFrame) -> DataFrame:
    """Run a plugged-in backend and check the shape of what it returns."""
    hits = backend(rungs)
    missing = {"query_id", "rung", "doc_id", "pos"} - set(hits.columns)
    if missing:
        raise ValueError(f"search backend returned no {sorted(missing)}")
    return hits


def judge(passages: DataFrame, score: Callable[[pd.DataFrame], pd.Series], keys: list[str], doc: str) -> DataFrame:
    """Scores of a user judge, batch by batch. ``operators.recall.rerank`` decides whether they count."""
    key_types = ", ".join(f"{k} {passages.schema[k].dataType.simpleString()}" for k in [*keys, doc])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*keys, doc]].assign(judge=score(pdf).astype(float))

    return passages.mapInPandas(run, f"{key_types}, judge double")


def learn(observations: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str, allowed: str = "source_spans") -> DataFrame:
    """Lessons of a user extractor, kept only where every cited span belongs to its source.

    ``schema`` must hold ``observation_id`` and ``spans``; extraction runs per batch of observations.
    """
    lessons = observations.mapInPandas(lambda batches: (extract(pdf) for pdf in batches), schema)
    cited = lessons.join(observations.select("observation_id", allowed), "observation_id")
    return cited.where(supported(F.col("spans"), F.col(allowed))).drop(allowed)

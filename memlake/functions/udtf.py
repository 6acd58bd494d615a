"""Table functions for Spark SQL: ``query_ladder``, ``passages``, ``sections`` (one row in, many out).

They are SQL functions over built-in expressions, for users who write ``SELECT ... FROM notes, LATERAL
sections(text, 24000)``. Only the cuts of sections, each of which depends on the one before, come from a
batch function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F, types as T

from memlake.functions.packs import section_ends

# Best terms first: capital unless it opens the question, a digit, length; ties in the order given.
RANKED = """transform(array_sort(transform(terms, (t, i) -> struct(
    NOT (substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND t <> first_word) AS a, NOT rlike(t, '[0-9]') AS b, -length(t) AS c, i, t))), s -> s.t)"""
BEST = lambda k: f"if(size(terms) > {k}, filter(terms, t -> array_contains(slice({RANKED}, 1, {k}), t)), NULL)"

LADDER = f"""CREATE OR REPLACE TEMPORARY FUNCTION query_ladder(terms ARRAY<STRING>, first_word STRING) RETURNS TABLE (rung INT, query STRING)
RETURN SELECT pos, array_join(r, ' ') FROM (SELECT posexplode(filter(array(terms, {BEST(5)}, {BEST(3)}, {BEST(2)}),
  r -> r IS NOT NULL AND (size(r) > 1 OR size(r) = size(terms) AND size(r) = 1))) AS (pos, r))"""

PASSAGES = """CREATE OR REPLACE TEMPORARY FUNCTION passages(text STRING, width INT) RETURNS TABLE (start INT, body STRING)
RETURN SELECT s, substr(coalesce(text, ''), s + 1, least(greatest(width, 40), 4000)) FROM (SELECT explode(
  sequence(0, greatest(length(coalesce(text, '')), 1) - 1, greatest(20, least(greatest(width, 40), 4000) * 3 DIV 4))) AS s)"""

SECTIONS = """CREATE OR REPLACE TEMPORARY FUNCTION sections(text STRING, width INT) RETURNS TABLE (start INT, end INT, body STRING)
RETURN SELECT b, e, substr(text, b + 1, e - b) FROM (SELECT explode(arrays_zip(array_prepend(cuts, 0), cuts)) AS z FROM (SELECT section_ends(text, width) AS cuts))
  LATERAL VIEW OUTER inline(array(struct(z.`0` AS b, z.cuts AS e))) AS b, e WHERE e IS NOT NULL"""


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ends(text: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([section_ends(t or "", n) for t, n in zip(text, size)])


def register(spark: SparkSession) -> None:
    spark.udf.register("section_ends", ends)
    for function in (LADDER, PASSAGES, SECTIONS):
        spark.sql(function)

"""Many keyword sets at once against the rule for one set; operations applied once."""

from pyspark.sql import functions as F

from memlake.operators import notes as nt
from memlake.sources import store as st

NOTES = [(1, "Plan", ["the plan", "Plan"], ["en", "en"], "A plan for Plans", "plan b"), (2, "other", None, None, None, None), (3, "planning", ["x"], ["de"], "nothing", "PLAN"), (4, "b", [], ["en"], "", "")]
SCHEMA = "doc_id long, stem string, aliases array<string>, tags array<string>, title string, preview string"


def test_sets_score_as_single_calls_do(spark):
    notes = spark.createDataFrame(NOTES, SCHEMA)
    sets = {7: (["plan", "b"], ["en"]), 8: (["Plan", "plan"], []), 9: (["zebra"], ["de", "de"]), 10: ([], ["en"])}
    words = spark.createDataFrame([(s, w) for s, (ws, _) in sets.items() for w in [*ws, ""]], "owner long, keyword string")
    tags = spark.createDataFrame([(s, g) for s, (_, gs) in sets.items() for g in gs], "owner long, tag string")
    whole = notes.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    whole = whole.fillna("", ["title", "preview"])
    want = set()
    for s, (ws, gs) in sets.items():
        want |= {(s, r.doc_id, r.score) for r in nt.related(whole, ws or ["no such word"], gs or ["no such tag"]).where("score > 0").collect()}
    for patterns in (20_000, 1):  # one pass, and several
        nt_points = nt.keyword_points(notes, "doc_id", words.select(F.lower("keyword").alias("keyword")), patterns)
        assert nt_points.groupBy("doc_id", "keyword").count().where("count > 1").count() == 0
    assert {tuple(r) for r in nt.related_sets(notes, "doc_id", "owner", words, tags).collect()} == want
    assert nt.related_sets(notes, "doc_id", "owner", words.limit(0), tags.limit(0)).collect() == []


def test_operations_are_applied_once(spark, tmp_path):
    root = str(tmp_path / "table")
    batch = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "op long, value string")
    for ids in ([], [1, 2, 2, None], [2, 3, None, None], [1, 2, 3]):
        st.upsert(batch(ids), root, "op")
    assert sorted((r.op or 0, r.value) for r in spark.read.parquet(root).collect()) == [(0, "vNone"), (1, "v1"), (2, "v2"), (3, "v3")]
    # Only the buckets that a batch touches are read.
    plan = spark.read.parquet(root).where(F.col("__bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [__bucket" in plan

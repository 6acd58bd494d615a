"""The recall plan on a few notes: every setting has an effect of its own."""

import pytest
from pyspark.sql import functions as F

from memlake.operators.recall import inject
from memlake.plans.recall import hybrid
from memlake.plans.settings import Settings, learn, search_with
from memlake.queries.retrieval import CONTEXT_BYTES, inject_sql, injected
from memlake.registry import Tables
from tests.oracle import compare, connect

TEXT = "This passage about the harbour crane number {} is long enough to be shown to the reader."
NOTES = [(i, f"qmd://{c}/{i}.md", c, k, ident, TEXT.format(i)) for i, c, k, ident in [
    (1, "work", "memo", "1"), (2, "work", "decision", "2"), (3, "mem", "memo", "3"), (4, "other", "memo", "4"), (5, "work", "memo", "m"), (6, "work", "memo", "m"), (7, "mem", "memo", "7")]]
QUESTIONS = [(1, "Where does the harbour crane stand?"), (2, "thanks")]
LEXICAL = [(1, 0, 4, 1), (1, 0, 1, 2), (1, 0, 2, 3), (1, 0, 6, 4), (1, 1, 5, 1), (1, 1, 3, 2), (2, 0, 1, 1)]
DENSE = [(1, 7, 0.9, 1), (1, 1, 0.2, 2)]


def run(spark, judge=None, **options):
    make = spark.createDataFrame
    rows = hybrid(make(QUESTIONS, "q int, question string"), make(LEXICAL, "q int, rung int, doc_id long, pos long"), make(DENSE, "q int, doc_id long, score double, pos long"),
                  make(NOTES, "doc_id long, uri string, collection string, kind string, identity string, text string"), "q", Settings(**options), judge).collect()
    assert all(r.q == 1 for r in rows)  # the acknowledgement is stopped by the gate
    return [r.doc_id for r in sorted(rows, key=lambda r: r.place)]


def test_defaults_fuse_mirrors_and_gate(spark):
    # 5 and 6 are one source: their votes add up and 5 stands for both.
    assert run(spark, inject=10, memory_slots=0) == [1, 7, 5, 4, 2, 3]


@pytest.mark.parametrize("options,want", [
    ({"collections": ("work",)}, [1, 5, 2]), ({"collections": ("work",), "memory_collections": ("mem",), "memory_slots": 0}, [1, 7, 5, 2, 3]),
    ({"collections": ("work",), "memory_collections": ("mem",), "memory_slots": 1}, [7, 1, 5, 2, 3]), ({"skip_paths": (r"/[12]\.md$",)}, [7, 5, 4, 3]), ({"prefer_types": ("decision",)}, [2, 1, 7, 5, 4, 3]),
    ({"vector_gate": 0.95}, [1, 5, 4, 2, 3]), ({"inject": 2}, [1, 7])])
def test_settings(spark, options, want):
    assert run(spark, **({"inject": 10, "memory_slots": 0} | options)) == want


def test_byte_budget_passes_over_what_does_not_fit(spark):
    size = len(TEXT.format(1))
    assert run(spark, inject=10, memory_slots=0, context_bytes=2 * size + 5) == [1, 7]
    assert run(spark, inject=10, memory_slots=0, context_bytes=size - 1) == []


def test_a_judge_counts_only_if_it_names_the_whole_top(spark):
    worth = lambda head: head.select("q", "doc_id", (F.col("doc_id") == 2).cast("double").alias("judge"))
    assert run(spark, worth, inject=10, memory_slots=0, rerank_top=5, rerank_blend=0.5)[0] == 2
    assert run(spark, lambda head: worth(head).where("doc_id <> 7"), inject=10, memory_slots=0, rerank_top=5, rerank_blend=0.5)[0] == 1


def test_a_backend_must_return_ranked_hits(spark):
    rungs = spark.createDataFrame([(1, 0, "x")], "query_id int, rung int, query string")
    good = search_with(lambda r: r.selectExpr("query_id", "rung", "1 AS doc_id", "1 AS pos"), rungs)
    assert good.count() == 1
    with pytest.raises(ValueError, match="pos"):
        search_with(lambda r: r.selectExpr("query_id", "rung", "1 AS doc_id"), rungs)


def test_lessons_need_spans_of_their_source(spark):
    seen = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "observation_id long, source_spans array<string>")
    out = learn(seen, lambda pdf: pdf.assign(spans=[["a"], ["x"]][:len(pdf)] if len(pdf) == 2 else [["a"] if i == 1 else ["x"] for i in pdf["observation_id"]], lesson="l")[["observation_id", "spans", "lesson"]],
                "observation_id long, spans array<string>, lesson string")
    assert [r.observation_id for r in out.collect()] == [1]


def test_inject_takes_memory_first_and_passes_over_what_does_not_fit(spark):
    rows = [(q, d, d, d in (3, 5, 6), size) for q in (1, 2) for d, size in enumerate([30, 90, 40, 50, 20, 10, 5], 1)]
    df = spark.createDataFrame(rows, "q int, doc_id long, pos long, memory boolean, size long")
    take = lambda **o: [(r.q, r.doc_id, r.place, r.memory) for r in inject(df, "q", "doc_id", size="size", **o).orderBy("q", "place").collect()]
    # 3 and 5 have the slots, 1 follows; 2 and 4 do not fit any more, 6 and 7 do.
    want = [(3, 1, True), (5, 2, True), (1, 3, False), (6, 4, True), (7, 5, False)]
    assert take(slots=2, limit=10, budget=105) == [(q, *w) for q in (1, 2) for w in want]
    assert take(slots=2, limit=4, budget=105) == [(q, *w) for q in (1, 2) for w in want[:4]]
    assert take(slots=2, limit=4, budget=4) == []


def test_inject_cut_keeps_the_context_in_its_budget(spark):
    sf, context = "/root/testdata/sf0.001", 1500
    con = connect(sf)
    same, note = compare(injected(Tables(spark, sf), context), con, inject_sql(context))
    assert same, note
    count = lambda c: len(con.execute(inject_sql(c)).fetchall())
    assert 0 < count(context) < count(CONTEXT_BYTES)

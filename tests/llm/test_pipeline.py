import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from memlake.llm import decontaminate, quality, simhash
from memlake.llm.tables import read, stored
from tests.llm.helpers import docs
from tests.llm.test_simhash import slow_components, slow_print

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark):
    table = read(spark, SF, "documents")
    after = {}
    for name, stage in cp.STAGES:
        after[name] = stored(stage(spark, table, SF), name)
        if name != "tokens":
            assert after[name].columns == COLUMNS
            table = after[name]
    text = lambda name: {r.doc_id: r.text for r in after[name].collect()}
    whole = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    model = quality.train(read(spark, SF, "documents"), read(spark, SF, "labels"))
    good = {d: t for d, t in whole.items() if model.score(quality.Features()(t)) >= 0.7}
    assert text("quality") == good
    ids = sorted(good)
    groups = slow_components(ids, [slow_print(good[d]) for d in ids])
    assert text("near_duplicates") == {d: good[d] for d, c in zip(ids, groups) if d == c}
    items = [decontaminate.plain(r.text) for r in read(spark, SF, "benchmark").collect()]
    held = text("near_duplicates")
    clean = text("decontamination")
    assert set(clean) <= set(held)
    for d, t in held.items():
        if any(i in decontaminate.plain(t) for i in items):
            assert d not in clean  # whole items at least; edits are compared in test_decontaminate
    assert text("mixing") == clean
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = [r.doc_id for r in after["mixing"].orderBy(cp.written_order(after["mixing"])).select("doc_id").collect()]
    start, want = 0, []
    for d in order:
        ids = tokenizer.encode(clean[d], add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after["tokens"].collect())) == sorted(want)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(want)


def test_odd_documents_pass_every_stage(spark):
    table = [(1, None), (2, ""), (3, "The words of a calm text stand here in order."), (3, "The words of a calm text stand here in order."), (None, "x" * 100_000)]
    df = stored(docs(spark, table, clash=True), "odd")
    for _, stage in cp.STAGES:
        stage(spark, df, SF).collect()
        stage(spark, df.limit(0), SF).collect()
    assert cp.written_order(docs(spark, table)) is None


def test_written_order_spans_the_files_of_a_task(spark):
    from memlake.llm.tables import place

    path = place(spark, "order")
    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 100).parquet(path)
    df = spark.read.parquet(path)
    assert [r.id for r in df.orderBy(cp.written_order(df)).collect()] == list(range(1000))


def test_near_duplicates_broadcast_no_exploded_keys(spark, monkeypatch):
    # Sized from the file of fingerprints, their keys were broadcast; a driver broke on them at 0.6 GB.
    plans, groups = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or groups(edges))
    assert cp.keep_one(spark, docs(spark, [(i, f"text number {i % 7} of a few words") for i in range(30)]), "").count() == 7
    assert len(plans) == 1 and "Generate explode" in plans[0] and "BroadcastHashJoin" not in plans[0]

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from memlake.operators import passages as ps

TEXT = "---\ntype: memo\n---\nFirst paragraph\nof two lines\n\n<!-- note -->\n" + "A long line of words. " * 400 + "\n \nlast"


def whole(text):
    front = ps.FRONT.match(text)
    return [(m.start(), m.end(), m[0]) for m in ps.PARAGRAPH.finditer(text, front.end() if front else 0)]


def test_paragraphs_of_a_large_batch_are_held_in_pieces():
    """One batch of 20 MB: the Python objects of a few pieces, not those of all texts and paragraphs."""
    texts = [None, "", TEXT, "x" * (3 * ps.PIECE_BYTES), *[f"{i}\n{TEXT}" for i in range(2000)], None]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    got, sizes = [], []
    for out in ps._paragraphs.func(iter([batch.slice(0, 0), batch])):
        sizes.append(len(out))
        for row in out.slice(0, 3).to_pylist():
            got.append(row if row is None else [tuple(p.values()) for p in row])
        del out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(texts) and got[:3] == [None, [], whole(TEXT)]
    assert peak < 12 * ps.PIECE_BYTES


def test_paragraphs_in_spark_equal_one_pass(spark):
    texts = [None, "", "\n", TEXT, *[f"{i}\n\n{TEXT}" for i in range(300)], "ä中\n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p and [tuple(p) for p in r.p] for r in df.select("i", ps._paragraphs(F.col("t")).alias("p")).collect()}
    assert got == {i: t and whole(t) if t != "" else [] for i, t in enumerate(texts)}

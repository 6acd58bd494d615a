import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from memlake.llm import tokens
from memlake.llm.tables import place
from tests.llm.helpers import docs, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
FULL = Tokenizer.from_file(PATH)
SHORT = tokens.Encoder(PATH)


def expected(table):
    out, start = [], 0
    for doc_id, text in table:
        ids = FULL.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!?'’-éÉßΣσİ́̌<|endoftext|>"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    assert list(SHORT.encode([text]))[0].tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_round_trip_equals_brute_force(spark):
    table = [(i * 3 - 5, f"Word {i}, " * (i % 7) + "the end\n") for i in range(300)] + [(1000, None), (1001, ""), (1002, "x" * 3000 + " y" * 50_000)]
    df = docs(spark, table[::-1], clash=True)
    got = tokens.round_trip(df, PATH).select("id", "start", "n_tokens", tokens.F.crc32("ids").alias("crc"))
    assert sorted(map(tuple, got.collect())) == sorted(expected(sorted(table)))


def test_null_and_repeated_keys(spark):
    table = [(None, "b c d"), (7, "a"), (7, "a"), (7, "z z z z"), (None, None)]
    got = sorted(map(tuple, tokens.round_trip(docs(spark, table), PATH).select("start", "id", "n_tokens").collect()))
    assert [g[1] for g in got] == [None, None, 7, 7, 7] and [g[2] for g in got] == [1, 4, 2, 2, 5]
    assert [g[0] for g in got] == [0, 1, 5, 7, 9]


def test_empty_table_and_fetch(spark):
    assert rows(tokens.round_trip(docs(spark, []), PATH)) == []
    path = place(spark, "t")
    tokens.write(docs(spark, [(i, f"text number {i}") for i in range(500)]), path, PATH)
    got = tokens.fetch(spark, path, [3, 499, 10_000])
    want = {i: np.array(FULL.encode(f"text number {i}", add_special_tokens=False).ids + [1], "<u4").tobytes() for i in (3, 499)}
    assert {r.id: bytes(r.ids) for r in got.collect()} == want
    assert tokens.fetch(spark, path, []).count() == 0


def test_blocks_hold_the_hash_of_the_dictionary(spark):
    path = place(spark, "t")
    tokens.write(docs(spark, [(i, f"text number {i} " * 20) for i in range(50)]), path, PATH)
    held = spark.read.parquet(f"{path}/dictionary").first()
    assert tokens.hashlib.sha256(bytes(held.data)).digest() == bytes(held.dictionary)
    assert {bytes(r.dictionary) for r in spark.read.parquet(f"{path}/blocks").collect()} == {bytes(held.dictionary)}

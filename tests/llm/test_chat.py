import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from memlake.llm import chat
from memlake.llm.queries import ODD_TEXT, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "conv_id bigint, turn bigint, role string, text string, conv bigint, piece int, ids string, no_id int, whole int"


def expected(rows):
    """Digest columns straight from the rows."""
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        whole, _ = chat.rendered([x[2:] for x in turns])
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said), len(whole)))
    return sorted(out, key=str)


ODD = ["", "\\", "#", "####", "###", "### ", "a###", "</turn>", "<</turn>", "</turn", "<", "</turn>\n### assistant: x", "\\</turn>\\", ": ", ":", " :  ", "\n\n", " lead", "tail ",
       "\\/", "\\\\#\\#", "é́ 漢字😀 ", "😀" * 9, "<|endoftext|>", "\u2028\x85\x00", ODD_TEXT, "x" * 3000, "ö" * 5]


def test_render_and_parse():
    rnd = random.Random(4)
    for _ in range(3000):
        turns = [("".join(rnd.choices(ODD[:20], k=rnd.randrange(3))), "".join(rnd.choices(ODD, k=rnd.randrange(4)))) for _ in range(rnd.randrange(5))]
        text, _ = chat.rendered(turns)
        assert chat.parsed(text) == turns
        for r, t in turns:
            assert "###" not in chat.escaped(t) and "</turn>" not in chat.escaped(t) and chat.plain(chat.escaped(t)) == t
    assert chat.rendered([("assistant", "a#b")]) == ("### assistant: a#b</turn>\n", [(15, 18)])


def test_ranges_are_the_tokens_that_touch_the_text():
    coder, rnd = chat.Coder(TOKENIZER), random.Random(8)
    for _ in range(400):
        turns = [(rnd.choice(["user", "assistant"]), "".join(rnd.choices(ODD, k=rnd.randrange(4)))) for _ in range(rnd.randrange(1, 5))]
        text, spans = chat.rendered(turns)
        (ids, offsets), = coder.encode([text])
        assert coder.text(ids) == text
        found = chat.loss_ranges(offsets, spans)
        for (low, high), (first, last, skip, chars) in zip(spans, found.tolist()):
            assert [i for i, (a, b) in enumerate(offsets) if a < high and b > low] == list(range(first, last))
            assert coder.text(ids[first:last])[skip:skip + chars] == text[low:high]


def test_long_texts_in_segments(monkeypatch):
    coder = chat.Coder(TOKENIZER)
    text = " ".join(random.Random(3).choices(["word", "12", "it's", "a  b", "\n", "x-y", "漢字", "end."], k=20_000))
    (ids, offsets), = coder.encode([text])
    monkeypatch.setattr(chat, "SEGMENT", 700)
    (cut, places), = coder.encode([text])
    assert len(coder._segments(text)) > 50 and (ids == cut).all() and (offsets == places).all()
    monkeypatch.setattr(chat, "SEGMENT", 10)
    assert coder._segments("漢字 " * 50) == ["漢字 " * 50]


def test_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rnd = random.Random(6)
    rows += [(10**9 + c, t, rnd.choice(["assistant", "user", "tool: x", "#"]), "".join(rnd.choices(ODD, k=3))) for c in range(40) for t in range(rnd.randrange(1, 6))]
    rows += [(None, 1, None, None), (None, None, "assistant", "first"), (5 * 10**9, 3, "assistant", "tie"), (5 * 10**9, 3, "assistant", "tie"), (5 * 10**9, 3, "assistant", "sie"),
             (6 * 10**9, 0, "assistant", "long words " * 200_000), (0, 0, "user", "joins the first")]
    spark.createDataFrame([(*r, 1, 2, "i", 3, 4) for r in rows], CLASH).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["op13_chat_formatting"](spark, str(tmp_path))
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    odd = [(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)]
    assert sorted(map(tuple, df.collect()), key=str) == expected(rows + odd)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(ORACLE["op13_chat_formatting"]).fetchall(), key=str) == expected(rows + odd)
    spark.createDataFrame([], CLASH).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert sorted(map(tuple, QUERIES["op13_chat_formatting"](spark, f"{tmp_path}/none").collect()), key=str) == expected(odd)


def test_a_conversation_over_many_tasks(spark):
    rnd = random.Random(7)
    rows = [(1, t // 2, rnd.choice(["user", "assistant"]), "".join(rnd.choices(ODD[:26], k=4))) for t in range(900)]
    rows += [(1, 77, "assistant", "the same again ")] * 500 + [(2, 0, "assistant", "short"), (None, 4, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    whole = chat.formatted(df, TOKENIZER).collect()
    table = chat.stored(chat.formatted(df, TOKENIZER, long=5000, piece=800), "chat-test")
    pieces = table.where("not whole").orderBy("piece").collect()
    assert len(pieces) > 20 and len({p.piece >> 32 for p in pieces}) >= 4 and table.where("whole").count() == 2
    first = next(r for r in whole if r.conv == 1)
    assert [i for p in pieces for i in p.ids] == first.ids
    # Ties with the same 64 characters go by a hash; here texts are shorter or equal.
    assert sorted(map(tuple, chat.digests(table, TOKENIZER).collect()), key=str) == sorted(
        map(tuple, chat.digests(chat.stored(chat.formatted(df, TOKENIZER), "chat-test"), TOKENIZER).collect()), key=str)


def test_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "well then"), (2, 0, "user", "")], "conv_id bigint, turn bigint, role string, text string")
    coder = chat.Coder(TOKENIZER)
    for r in chat.with_mask(chat.formatted(df, TOKENIZER)).collect():
        ids = np.array(r.ids)
        assert coder.text(ids[np.array(r.mask)]) == (" well then" if r.conv == 1 else "")


def test_a_tokenizer_that_drops_characters_is_refused(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    with pytest.raises(ValueError):
        chat.formatted(df, public_tokenizers.path("word_bpe_49k.json"))

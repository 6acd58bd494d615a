import base64
import gzip
import hashlib
import io

import pytest

from memlake.llm import warc
from memlake.llm.tables import place

SCHEMA = "page_id bigint, url string, html string, id int, digest string, first string"
END = b"\r\n\r\n"


def captures(spark, table, **options):
    path = place(spark, "warc")
    warc.write(spark.createDataFrame([(*t, 0, "x", "y") for t in table], SCHEMA), path, **options)
    return path, warc.assemble(warc.read(spark, path)).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n\x00é漢 <p>"
    table = [(3, "http://a/x y\r\nInjected: 1", tricky), (1, None, "same"), (2, "http://b/", "same"), (5, "http://c/", None), (4, "http://d/", ""), (None, "http://e/", "same"), (9, "u", "x" * 300_000), (7, "v", "w"), (7, "v", "w")]
    _, got = captures(spark, table)
    assert len(got) == len(table)
    facts = []
    for c in got:
        meta, response = __import__("json").loads(bytes(c.metadata.payload)), c.response
        refers = response.refers_to and int(response.refers_to.split(":")[2].rstrip(">"))
        facts.append((meta.get("page_id"), meta.get("url"), meta["payload_bytes"], response.digest, response.kind, refers))
        assert c.request is not None and bytes(c.request.payload) == b""
        if response.kind == "response":
            want = next(h for p, u, h in table if p == meta.get("page_id") and u == meta.get("url"))
            assert bytes(response.payload).decode() == (want or "") and response.payload_digest == digest(want)
    first = {"same": 1, "": 4, None: 4}
    want = [(p, u, len((h or "").encode()), "sha1:" + digest(h), "revisit" if h in first and p != first[h] else "response", first[h] if h in first and p != first[h] else None) for p, u, h in table]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(facts, key=key) == sorted(want, key=key)


def test_small_payloads_and_nulls(spark):
    table = [(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "long enough"), (4, "u", "long enough"), (None, "a", "only nulls here"), (None, "b", "only nulls here")]
    _, got = captures(spark, table, least_bytes=5)
    assert sorted(c.response.kind for c in got) == ["response"] * 5 + ["revisit"]
    assert captures(spark, [])[1] == []


def test_files_are_warc(spark):
    path, _ = captures(spark, [(1, "http://a/", "body")])
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    assert all(n.endswith(".gz") for n in names)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect())
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(END)
    kinds = [h["warc-type"] for h, _ in warc.parse(io.BytesIO(data))]
    assert kinds == ["request", "response", "metadata"]


def test_broken_archives_raise():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"ab", b"ab"]
    for bad in (b"nonsense\r\n", good[:-6]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_assembly_of_incomplete_captures(spark):
    row = lambda i, kind, to=None: (i, kind, to, None, "u", None, "t", bytearray(b"p"), 1, "d")
    records = spark.createDataFrame([row("r1", "response"), row("m1", "metadata", "r1"), row("m0", "metadata", "r1"), row("r2", "revisit"), row("q3", "request", "gone"), row("x", "warcinfo"), row(None, "response"), row("m9", "metadata")], warc.RECORD)
    got = {c.capture_id: (c.request and c.request.record_id, c.response and c.response.kind, c.metadata and c.metadata.record_id) for c in warc.assemble(records).collect()}
    assert got == {"r1": (None, "response", "m0"), "r2": (None, "revisit", None), "gone": ("q3", None, None)}

"""Timers against plain loops; readers on real files."""

import datetime
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memlake.operators.metrics import opened_after
from memlake.queries import demo
from memlake.queries.streams import _failures
from memlake.registry import Tables
from memlake.sources import files as fi, store as st
from memlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_retry_attempts(spark):
    t = Tables(spark, SF)
    want, last, resume = defaultdict(int), {}, datetime.datetime(2024, 1, 10, 6)
    for r in demo.hooks(t).where("event IN ('Stop', 'PostToolUseFailure')").orderBy("ts", "event_id").collect():
        want[r.session_id] += r.event != "Stop" and r.ts >= resume
        if r.event == "Stop":
            want[r.session_id] = 0
        elif r.ts >= resume:
            last[r.session_id] = r.ts
    wait = lambda a: datetime.timedelta(seconds=min(3600, 60 * 2 ** min(a - 1, 6)))
    got = {r.session_id: (r.attempts, r.parked, r.due) for r in entry.queries()["stream_retry_timers"](spark, SF).collect()}
    assert got == {s: (a, a >= 8, max(last[s] + wait(a), resume) if 0 < a < 8 else None) for s, a in want.items()}


def test_resume_times():
    assert jobs.resume_time(None) is None and jobs.resume_time("") is None
    assert jobs.resume_time("2024-01-10T06:00:00+02:00") == pd.Timestamp("2024-01-10T04:00:00Z")
    for bad in ("soon", "2024-01-10T06:00:00"):  # fails closed
        assert jobs.resume_time(bad).year > 2200


def _place(row):
    return tuple(-1 if v is None else v for v in row)


def _sessions(spark, tmp_path, batches, delay="0 seconds", gap="1 minute"):
    """Closed sessions after each batch of (session_id, second, event, n), and how many keys hold state at the end."""
    folder, out, checkpoint, seen = (str(tmp_path / n) for n in ("in", "out", "cp", "s"))
    after = []
    for rows in batches:
        spark.createDataFrame([(s, None if at is None else datetime.datetime.fromtimestamp(at, datetime.UTC), e, n) for s, at, e, n in rows],
                              "session_id long, ts timestamp, event string, n long").write.mode("append").parquet(folder)
        stream = jobs.tail(spark, folder, "session_id long, ts timestamp, event string, n long")
        done = jobs.drain(jobs.session_state(stream, ["n"], delay, gap), out, checkpoint, timers=True).collect()
        second = lambda v: None if v is None else int(v.timestamp())
        after.append(sorted(((r.session_id, second(r.first_ts), second(r.last_ts), r.processed, r.stale, r.prompts, r.reason) for r in done), key=_place))
    return after, spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load().count()


def test_sessions_close_once_and_are_forgotten(spark, tmp_path):
    after, held = _sessions(spark, tmp_path, [
        [(1, 1000, "UserPromptSubmit", 1), (1, 1010, "Stop", 2), (1, 1005, "PostToolUse", 3), (2, 1000, "SessionStart", 4), (3, None, "Stop", 5)],
        [(1, 1020, "UserPromptSubmit", 6), (2, 1030, "UserPromptSubmit", 7), (4, 1030, "SessionEnd", 8)],
        [(2, 1200, "SessionStart", 9)],
        [(9, 10_000, "SessionStart", 10)],
        [(9, 20_000, "Stop", 11)],
        [(8, 90_000, "Stop", 12)],
        [(8, 99_000, "Stop", 13)]])
    assert after[0] == [(1, 1000, 1010, 2, 0, 1, "stop")]
    assert after[1] == [*after[0], (4, 1030, 1030, 1, 0, 0, "stop")]
    # The straggler of session 1 was counted behind the mark that outlived its stop.
    assert (1, 1020, 1020, 2, 1, 1, "idle") in after[3] and (2, 1000, 1030, 2, 0, 1, "idle") in after[3]
    assert (2, 1200, 1200, 1, 0, 0, "idle") in after[3]
    assert after[-1] == sorted([*after[3], (9, 10_000, 10_000, 1, 0, 0, "idle"), (9, 20_000, 20_000, 1, 0, 0, "stop"),
                                (8, 90_000, 90_000, 1, 0, 0, "stop"), (8, 99_000, 99_000, 1, 0, 0, "stop")], key=_place)
    assert held == 1  # the mark of the last session, until time passes it


def test_sessions_do_not_depend_on_batches(spark, tmp_path):
    rnd, at, rows = random.Random(9), 0, []
    for n in range(600):
        at += rnd.choice([0, 1, 1, 5, 40])
        rows.append((rnd.randrange(6), at - rnd.choice([0, 0, 0, 7]), rnd.choice(["Stop", "UserPromptSubmit", "PostToolUse", "PostToolUse"]), n))
    end = [(-1, at + 10**6, "Stop", 9999)]
    one, none = _sessions(spark, tmp_path / "one", [rows + end], "1 hour", "1 minute")
    some, _ = _sessions(spark, tmp_path / "some", [rows[i:i + 60] for i in range(0, 600, 60)] + [end], "20 seconds", "1 minute")
    want = []
    for s in range(6):
        high, place = None, None
        for _, ts, event, _ in [r for r in rows if r[0] == s]:
            taken = high is None or ts >= high
            if place and taken and high is not None and ts >= high + 60:
                want.append((*place, "idle"))
                place = None
            place = place or [s, None, None, 0, 0, 0]
            place[3] += 1
            place[4] += not taken
            if taken:
                high, place[1], place[2] = ts, ts if place[1] is None else place[1], ts
                place[5] += event == "UserPromptSubmit"
                if event == "Stop":
                    want.append((*place, "stop"))
                    place = None
        want += [(*place, "idle")] if place else []
    closed = lambda found: [r for r in found[-1] if r[0] >= 0]
    assert closed(one) == closed(some) == sorted(want, key=_place)
    assert none == 1  # only the row that moved the time on


def test_sessions_of_a_bucket_share_a_state_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SESSION_BUCKETS", 1)
    after, held = _sessions(spark, tmp_path, [
        [(1, 1000, "UserPromptSubmit", 1), (3, 1100, "SessionStart", 2), (2, 5000, "UserPromptSubmit", 3)],
        [(2, 5010, "Stop", 4), (4, 90_000, "SessionStart", 5), (5, 90_001, "SessionStart", 6)]])
    assert after[-1] == [(1, 1000, 1000, 1, 0, 1, "idle"), (2, 5000, 5010, 2, 0, 1, "stop"), (3, 1100, 1100, 1, 0, 0, "idle")]
    assert held == 1  # of the two that are open


def test_once_per_signature_and_ttl(spark):
    last, want = {}, set()
    for r in _failures(Tables(spark, SF)).orderBy("ts", "event_id").collect():
        k, at = (r.session_id, r.signature), r.ts.timestamp()
        if at - last.get(k, float("-inf")) >= 6 * 3600:
            last[k] = at
            want.add((r.session_id, r.signature, r.event_id))
    assert {tuple(r) for r in entry.queries()["stream_ttl_suppress"](spark, SF).collect()} == want


def test_suppression_calls_python_per_bucket(spark, tmp_path, monkeypatch):
    """Many pairs share a call: each call writes one state row, and pairs without a session are pairs too."""
    monkeypatch.setattr(jobs, "SUPPRESS_BUCKETS", 4)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema, want = "session_id long, signature string, ts timestamp, event_id long", set()
    for batch in range(2):
        at = [datetime.datetime.fromtimestamp(100_000 + 3600 * batch + s, datetime.UTC) for s in (0, 10, 70)]
        rows = [(s or None, f"f{s % 7}", at[i], 1000 * batch + 3 * s + i) for s in range(100) for i in range(3)]
        want |= {(s, g, e) for s, g, t, e in rows if t != at[1]}
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        got = jobs.drain(jobs.suppress_repeats(jobs.tail(spark, folder, schema), "1 minute", 60.0), out, checkpoint)
    assert {tuple(r) for r in got.collect()} == want
    assert 0 < spark.read.format("statestore").option("path", checkpoint).load().count() <= 4


def test_line_numbers_survive_file_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = fi.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.value == f"line {r.line}" for r in rows)


def test_markdown_tree(spark, tmp_path):
    for p in ("a/x.md", "templates/t.md", ".hidden/h.md", "a/.git/g.md", "a/y.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("hello")
    assert [(r.path, r.size) for r in fi.read_markdown(spark, str(tmp_path)).collect()] == [("a/x.md", 5)]


def test_chunk_sink_writes_only_missing(spark, tmp_path):
    c = spark.createDataFrame([("s", "r1", "x"), ("s", "r1", "x"), ("s", "r2", "y")], "scope string, revision string, body string")
    stored = spark.createDataFrame([("s", "r2")], "scope string, revision string")
    st.write_chunks(c, stored, c.select("scope", "revision"), str(tmp_path))
    assert [r.revision for r in spark.read.parquet(f"{tmp_path}/chunks").collect()] == ["r1"]
    assert spark.read.parquet(f"{tmp_path}/manifests").count() == 3


def test_opened_needs_a_read_before_the_next_prompt(spark):
    ts = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    hits = spark.createDataFrame([(1, 7, ts(10), "a/n.md"), (2, 7, ts(300), "a/n.md"), (3, 8, ts(10), "a/n.md")], "id long, u long, t string, path string") \
        .select("id", "u", F.col("t").cast("timestamp_ntz").alias("ts"), "path")
    rows = spark.createDataFrame([(7, ts(100), True, ""), (7, ts(120), False, "cat n.md"), (7, ts(310), False, "cat n.md"), (8, ts(9), False, "read a/n.md")],
                                 "u long, t string, is_prompt boolean, tool_text string").select("u", F.col("t").cast("timestamp_ntz").alias("ts"), "is_prompt", "tool_text")
    got = {r.id: r.opened for r in opened_after(hits, rows, "u", 2, 1800, 5).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_opened_equals_all_pairs(spark):
    rnd = random.Random(11)
    stamp = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    paths = ["a/n.md", "b/n.md", "c/long name.py", "d/", None, "x.md"]
    hits = [(i, rnd.choice([1, 1, 1, 2, None]), stamp(rnd.randrange(4000)), rnd.choice(paths)) for i in range(120)]
    rows = [(rnd.choice([1, 1, 2, None]), stamp(rnd.randrange(4000)), rnd.random() < .2, rnd.choice(["cat n.md", "xn.mdx", "open c/long name.py now", "", None, "n.m", "cp x.md n.md"])) for _ in range(300)]
    want = {}
    for i, s, t, path in hits:
        name = None if path is None else path.split("/")[-1]
        near = [(u, p, x) for w, u, p, x in rows if w is not None and w == s and -2 <= (u - t).total_seconds() <= 600]
        reads = [u for u, p, x in near if not p and x is not None and name is not None and name in x]
        prompts = [u for u, p, x in near if p and (u - t).total_seconds() > 5]
        want[i] = bool(reads) and (not prompts or min(reads) < min(prompts))
    h = spark.createDataFrame(hits, "id long, u long, ts timestamp, path string")
    r = spark.createDataFrame(rows, "u long, ts timestamp, is_prompt boolean, tool_text string")
    assert {x.id: x.opened for x in opened_after(h, r, "u", 2, 600, 5).collect()} == want


def test_refresh_merges_and_keeps_tombstones(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "root", "cp"))
    schema = "doc_id long, generation long, text string"
    builds = {"rows": lambda n: n.where("text <> ''").select("doc_id", "generation", "text"), "sizes": lambda n: n.where("text IS NOT NULL").selectExpr("doc_id", "generation", "length(text) AS size")}

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)

    def run():
        jobs.refresh_index(spark, jobs.tail(spark, folder, schema), root, builds, checkpoint, batches=2)
        return {(r.doc_id, r.text) for r in jobs.indexed(spark, root, "rows").collect()}, {(r.doc_id, r.size) for r in jobs.indexed(spark, root, "sizes").collect()}

    left = lambda: {tuple(r) for r in jobs.dirty(spark, root, spark.read.schema(schema).parquet(folder), ["rows", "sizes"]).collect()}
    arrive([(1, 1, "a"), (2, 1, "b"), (2, 2, "bb")])
    assert run() == ({(1, "a"), (2, "bb")}, {(1, 1), (2, 2)}) and left() == set()
    arrive([(1, 3, None), (3, 1, "c")])
    assert left() == {(1, 3), (3, 1)}  # dirty until a second run acknowledges them
    assert run() == ({(2, "bb"), (3, "c")}, {(2, 2), (3, 1)}) and left() == set()
    assert jobs._mark(spark, root) == (0, -1)
    arrive([(4, 1, "d")])
    assert run()[0] == {(2, "bb"), (3, "c"), (4, "d")} and jobs._mark(spark, root) == (1, 2)
    arrive([(1, 2, "late and old"), (3, 4, "")])  # the tombstone of 1 outlives the merge
    assert run() == ({(2, "bb"), (4, "d")}, {(2, 2), (3, 0), (4, 1)}) and left() == set()
    jobs.merge(spark, root, list(builds), 0)
    assert jobs._mark(spark, root)[0] == 2 and {(r.doc_id, r.text) for r in jobs.indexed(spark, root, "rows").collect()} == {(2, "bb"), (4, "d")}


def test_refresh_prepares_notes_once_for_all_indexes(spark, tmp_path):
    folder, root, seen = str(tmp_path / "in"), str(tmp_path / "root"), spark.sparkContext.accumulator(0)
    schema = "doc_id long, generation long, text string"
    spark.createDataFrame([(1, 1, "a b"), (2, 1, "c")], schema).write.parquet(folder)

    def cut(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    builds = {"rows": lambda notes: notes.select("doc_id", "generation", "text"), "sizes": lambda notes: notes.select("doc_id", "generation", F.length("text").alias("size"))}
    jobs.refresh_index(spark, jobs.tail(spark, folder, schema), root, builds, str(tmp_path / "cp"), prepare=lambda notes: notes.mapInArrow(cut, schema))
    assert {(r.doc_id, r.size) for r in jobs.indexed(spark, root, "sizes").collect()} == {(1, 3), (2, 1)}
    assert seen.value == 2

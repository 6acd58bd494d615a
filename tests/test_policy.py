"""Restrictions of nested records: every depth, every kind of damage."""

from memlake.operators import policy as po


def _found(spark, records):
    df = spark.createDataFrame([(f"k{i}", r) for i, r in enumerate(records)], "file string, raw string")
    out = {f"k{i}": {} for i in range(len(records))}
    for r in po.restrictions(df, "file", "raw", "memlake").collect():
        out[r.file].setdefault(r.kind, set()).add(r.value)
    return list(out.values())


def test_controls_at_every_depth(spark):
    deep = "[" * 40 + '{"PRIVATE": 1}' + "]" * 40
    claim = r'"x\n<!-- memlake:claim {\"audiences\": [\"host\", \"model\"], \"derivation_sources\": [\"o1\"]} -->"'
    private = {"audience": {"host", "local"}}
    assert _found(spark, [
        '{"private": true}', '{"private": "false", "a": {"Private": false}}', f'{{"a": {deep}}}', '{"a": [{"private": null}]}', f'{{"m": [{{"t": {claim}}}]}}',
        f'{{"m": [{{"t": {claim}}}, {{"private": 0}}]}}', r'{"t": "---\nprivate: true\n---\n"}', r'{"t": "---\nderivation_sources: [\"n1\"]\n---\n"}', '{"a": [{"derivation_sources": ["x", "y"]}]}',
        '{"text": "<!-- nothing -->"}', "{}"]) == [
        private, {}, private, private, {"audience": {"host", "model"}, "origin": {"o1"}}, {"audience": {"host"}, "origin": {"o1"}}, private, {"origin": {"n1"}}, {"origin": {"x", "y"}}, {}, {}]


def test_damage_marks_unresolved(spark):
    damaged = ['{"a": ', '[{"private": true}]', '{"a": 1}}', '{"a": 1}, {"b": 2}', '{"a": 1, "a": 2}', "7", "", None, '{"derivation_sources": "n1"}', '{"a": {"derivation_sources": ["n1", 4]}}',
               r'{"t": "<!-- memlake:provenance {broken} -->"}', r'{"t": "<!-- memlake:claim {\"audiences\": \"host\"} -->"}']
    assert all(f.get("unresolved") == {"true"} for f in _found(spark, damaged))


def test_records_of_one_file_meet(spark):
    rows = [("f", '{"private": true}'), ("f", '{"a": "plain"}'), ("f", r'{"t": "<!-- memlake:claim {} -->"}'), ("g", '{"a": 1}')]
    got = po.restrictions(spark.createDataFrame(rows, "file string, raw string"), "file", "raw", "memlake").collect()
    assert [tuple(r) for r in got] == [("f", "audience", "host")]
    assert po.restrictions(spark.createDataFrame([], "file string, raw string"), "file", "raw", "memlake").collect() == []

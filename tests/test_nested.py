import json

from hypothesis import given, settings
from hypothesis import strategies as st

from failscope.operators import nested as N


def brute(v, path="", owner="", root=True):
    """(path, parent) by plain recursion."""
    out = []
    if isinstance(v, dict):
        if not root:
            out.append((path, owner))
        for k, x in v.items():
            out += brute(x, f"{path}.{k}" if path else k, "" if root else path, False)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += brute(x, f"{path}[{i}]", owner, False)
    return out


VALUES = st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_paths_match_recursion(v):
    assert [(p, q) for _, p, q, *_ in N.nodes_of(v, objects_only=True)] == brute(v)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_store_and_bridge_hold_all_of_a_value(v):
    nodes = list(N.nodes_of(v))
    bodies = {n[5]: n[7] for n in nodes}
    assert nodes[0][0] == "root" and N.rebuilt(nodes[0][5], bodies) == v
    assert all(n[6] in bodies for n in nodes[1:]) and [n for n in nodes if n[0] == "object"] == list(N.nodes_of(v, objects_only=True))


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_deep_parser_agrees(v):
    assert N._deep_parse(json.dumps(v)) == v


def test_identity_ignores_key_order_and_is_shared():
    a = list(N.nodes_of(json.loads('{"x": {"a": 1, "b": [{"c": 2}]}, "y": {"b": [{"c": 2}], "a": 1}}')))
    ids = {n[1]: n[5] for n in a}
    assert ids["x"] == ids["y"] and ids["x.b[0]"] == ids["y.b[0]"] != ids["x"]


def test_values_read():
    assert N.parse('"{\\"a\\": {}}"') == (True, {"a": {}})
    assert N.parse('"text"') == (True, "text")
    assert N.parse('{"a": NaN}')[0] is False and N.parse('{"a": ')[0] is False and N.parse("{'a': 1}")[0] is False
    ok, v = N.parse("[" * 200_000 + "{}" + "]" * 200_000)
    assert ok and sum(1 for _ in N.nodes_of(v, objects_only=True)) == 1


def test_frame(spark):
    rows = [
        ("t", "s1", '[{"step_id": 1, "via": {"tool": null}}]', '{"results": [{"meta": {}}], "grid": [[1, {"k": 1}]]}', None), ("t", "s1", '[{"step_id": 1, "via": {"tool": null}}]', '{"results": [{"meta": {}}], "grid": [[1, {"k": 1}]]}', None),
        ("t", "s2", None, "", "not json"), ("t", "s3", "[]", '{"a": 1}', '"{\\"b\\": {}}"'), (None, None, '[{"\\ud800": {}}]', None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "trace_id string, step_uid string, dependencies_json string, tool_output_json string, state_snapshot_json string, path string")
    got = sorted((r.step_uid or "", r.field, r.path, r.parent_path) for r in N.occurrences(df, objects_only=True).collect())
    assert got == [
        ("", "dependencies_json", "[0]", ""), ("", "dependencies_json", "[0].?", "[0]"),
        ("s1", "dependencies_json", "[0]", ""), ("s1", "dependencies_json", "[0].via", "[0]"), ("s1", "tool_output_json", "grid[0][1]", ""),
        ("s1", "tool_output_json", "results[0]", ""), ("s1", "tool_output_json", "results[0].meta", "results[0]"), ("s3", "state_snapshot_json", "b", ""),
    ]
    bridge = N.occurrences(df).collect()
    bodies = {r.object_id: r.body for r in N.object_store(N.occurrences(df)).collect()}
    roots = {(r.step_uid, r.field): N.rebuilt(r.object_id, bodies) for r in bridge if r.kind == "root"}
    assert roots["s1", "tool_output_json"] == {"results": [{"meta": {}}], "grid": [[1, {"k": 1}]]} and roots["s3", "dependencies_json"] == [] and ("s2", "state_snapshot_json") not in roots
    assert N.object_store(N.occurrences(df)).filter("n_occurrences > 1").count() == 1  # {} occurs three times
    assert N.occurrences(df.limit(0)).count() == 0

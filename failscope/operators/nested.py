"""Problem 6: deeply nested semi-structured records as related flat tables.

Each JSON value is canonicalised and hashed bottom-up (a Merkle tree): the identity of an object is
a digest of its sorted keys and the identities of its values, so equal objects have equal ids
however their keys are ordered. `occurrences` has one bridge row for every node: the root of a value, every
array and every object, with its path, ordinal, parent and root; `object_store` keeps each distinct node
once, as JSON in which nested nodes stand as {"#": id}, so bridge and store hold all that the values do
(`rebuilt`).

Scale: steps are reduced to one row a key before anything is parsed, with map-side combine; then
occurrences need no shuffle at all (one narrow Arrow pass over the three JSON columns). The store is one
aggregation by digest with map-side combine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import require, table

FIELDS = ("dependencies_json", "tool_output_json", "state_snapshot_json")

BRIDGE_SCHEMA = "trace_id string, step_uid string, field string, kind string, path string, parent_path string, ordinal int, depth int, object_id string, parent_id string, body string"


def _reject(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_reject)
_SCALARS = json.JSONDecoder(parse_constant=_reject)
_BLANK = " \t\n\r"


def _deep_parse(s: str):
    """json without recursion, for values nested deeper than the standard parser goes."""
    i, n = 0, len(s)
    stack: list = []
    root: list = []

    def skip(i: int) -> int:
        while i < n and s[i] in _BLANK:
            i += 1
        return i

    state = "value"
    while True:
        i = skip(i)
        if state == "value" or state == "first":
            if i >= n:
                raise ValueError("end")
            c = s[i]
            if state == "first" and c == "]":
                value, i = stack.pop()[0], i + 1
            elif c == "[":
                stack.append(([], None))
                i, state = i + 1, "first"
                continue
            elif c == "{":
                i = skip(i + 1)
                if i < n and s[i] == "}":
                    value, i = {}, i + 1
                else:
                    stack.append(({}, []))
                    state = "key"
                    continue
            else:
                value, i = _SCALARS.raw_decode(s, i)
        elif state == "key":
            if i >= n or s[i] != '"':
                raise ValueError("key")
            key, i = _SCALARS.raw_decode(s, i)
            i = skip(i)
            if i >= n or s[i] != ":":
                raise ValueError("colon")
            stack[-1][1][:] = [key]
            i, state = i + 1, "value"
            continue
        # a value is complete: hang it in, then close as far as the text does
        while True:
            if not stack:
                if skip(i) != n:
                    raise ValueError("rest")
                root.append(value)
                return root[0]
            box, key = stack[-1]
            if key is None:
                box.append(value)
            else:
                box[key[0]] = value
            i = skip(i)
            if i >= n:
                raise ValueError("end")
            if s[i] == ",":
                i, state = i + 1, "value" if key is None else "key"
                break
            if s[i] == ("]" if key is None else "}"):
                value, i = stack.pop()[0], i + 1
                continue
            raise ValueError("separator")


def parse(s: str):
    """(True, value) of valid JSON text, else (False, None); a JSON string holding JSON is read through once."""
    ok, v = _parse_once(s)
    if ok and isinstance(v, str):
        inner, w = _parse_once(v)
        if inner:
            return True, w
    return ok, v


def _parse_once(s: str):
    try:
        i = 0
        while i < len(s) and s[i] in _BLANK:
            i += 1
        v, end = _DECODER.raw_decode(s, i)
        return (True, v) if not s[end:].strip(_BLANK) else (False, None)
    except RecursionError:
        try:
            return True, _deep_parse(s)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def _digest(s: str) -> str:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _utf8(s: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, become question marks."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _scalar(x) -> str:
    """JSON of a scalar; a number beyond the range of doubles stays one."""
    return json.dumps(x) if x not in (float("inf"), float("-inf")) else "1e999" if x > 0 else "-1e999"


def nodes_of(value, objects_only: bool = False) -> Iterator[tuple[str, str, str, int, int, str, str | None, str]]:
    """(kind, path, parent_path, ordinal, depth, object_id, parent_id, body) of each node, in document order, without recursion.

    kind is root, array or object (below the root; with objects_only no others come out). parent_path is that
    of the nearest enclosing object. The ordinal counts an object among the objects, an array among the
    arrays, of its nearest enclosing object; depth counts enclosing objects and arrays. parent_id is the id
    of the nearest enclosing object, or of the root. body is the canonical JSON, in which nested nodes stand as
    {"#": id}.
    """
    if not isinstance(value, (dict, list)):
        if not objects_only:
            body = _scalar(value)
            yield "root", "", "", 0, 0, _digest(body), None, body
        return
    # nodes in document order: value, key or position, holder, index of the nearest enclosing object, ordinal, depth; 0 is the root
    nodes: list[tuple] = []
    children: list[list[int]] = []
    counts: dict[tuple[int, bool], int] = {}
    todo = [(value, "", -1, -1, 0)]
    while todo:
        v, key, holder, owner, depth = todo.pop()
        me = len(nodes)
        ordinal = 0
        if me:
            sort = (owner, isinstance(v, dict))
            ordinal = counts.get(sort, 0)
            counts[sort] = ordinal + 1
        nodes.append((v, key, holder, owner, ordinal, depth))
        children.append([])
        if holder >= 0:
            children[holder].append(me)
        inside = me if isinstance(v, dict) or not me else owner
        items = v.items() if isinstance(v, dict) else enumerate(v)
        todo += [(x, k, me, inside, depth + 1) for k, x in reversed(list(items)) if isinstance(x, (dict, list))]

    def path_of(me: int) -> str:
        """Put together only where it is asked for, so that deep nesting keeps no long paths in memory."""
        parts = []
        while me > 0:
            key, me = nodes[me][1], nodes[me][2]
            parts.append(f"[{key}]" if isinstance(key, int) else f".{key}")
        path = "".join(reversed(parts))
        return path[1:] if path[:1] == "." else path

    ids = [""] * len(nodes)
    bodies = [""] * len(nodes)
    for me in range(len(nodes) - 1, -1, -1):  # children come after their holder, so this is bottom-up
        v = nodes[me][0]
        nested = iter(children[me])
        if isinstance(v, dict):
            parts = {k: f'{{"#":"{ids[next(nested)]}"}}' if isinstance(x, (dict, list)) else _scalar(x) for k, x in v.items()}
            bodies[me] = "{" + ",".join(f"{json.dumps(k)}:{parts[k]}" for k in sorted(parts)) + "}"
        else:
            bodies[me] = "[" + ",".join(f'{{"#":"{ids[next(nested)]}"}}' if isinstance(x, (dict, list)) else _scalar(x) for x in v) + "]"
        ids[me] = _digest(bodies[me])
    for me, (v, _, _, owner, ordinal, depth) in enumerate(nodes):
        kind = "root" if not me else "object" if isinstance(v, dict) else "array"
        if kind == "object" or not objects_only:
            yield kind, path_of(me), path_of(owner) if me else "", ordinal, depth, ids[me], ids[owner] if me else None, bodies[me]


def rebuilt(object_id: str, bodies: dict[str, str]):
    """The value of a node, from the bodies of the store."""
    def inline(x):
        if isinstance(x, dict) and list(x) == ["#"]:
            return rebuilt(x["#"], bodies)
        return x

    v = json.loads(bodies[object_id])
    return {k: inline(x) for k, x in v.items()} if isinstance(v, dict) else [inline(x) for x in v] if isinstance(v, list) else v


def _bridge(batches: Iterator[pa.RecordBatch], objects_only: bool) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in BRIDGE_SCHEMA.split(",")]
    types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()] * 3
    schema = pa.schema(list(zip(names, types)))

    def flush(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema=schema)

    for b in batches:
        cols: list[list] = [[] for _ in names]
        size = 0
        traces, uids = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k, field in enumerate(FIELDS):
            for trace, uid, s in zip(traces, uids, b.column(2 + k).to_pylist()):
                if not s or (objects_only and "{" not in s):
                    continue
                ok, v = parse(s)
                if not ok:
                    continue
                for kind, path, parent, ordinal, depth, oid, pid, body in nodes_of(v, objects_only):
                    for c, x in zip(cols, (trace, uid, field, kind, _utf8(path), _utf8(parent), ordinal, depth, oid, pid, body)):
                        c.append(x)
                    size += len(path) + len(parent) + len(body) + 200
                    if size > 8_000_000:
                        yield flush(cols)
                        cols, size = [[] for _ in names], 0
        yield flush(cols)


def one_row_a_step(steps: DataFrame) -> DataFrame:
    """The earliest row of each step_uid, as far as nested records need it; ties go to the smaller values."""
    columns = ["trace_id", *FIELDS]
    if "ingested_at" in steps.columns:
        rows, order = require(steps, "step_uid", *columns, "ingested_at"), ["ingested_at", *FIELDS]
    else:
        rows, order = require(steps, "step_uid", *columns), list(FIELDS)
    return rows.groupBy("step_uid").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.trace_id", "step_uid", *[f"r.{f}" for f in FIELDS])


def occurrences(steps: DataFrame, objects_only: bool = False) -> DataFrame:
    """Bridge rows (BRIDGE_SCHEMA) of every node of the three JSON columns of `steps`, or of the objects below the root only.

    Defined results: null, empty and invalid JSON give no rows, and a scalar root one row of kind root;
    NaN and Infinity are invalid JSON; of repeated keys the last counts; of repeated rows of one
    step_uid the earliest counts; other columns are ignored.
    """
    return one_row_a_step(steps).mapInArrow(lambda batches: _bridge(batches, objects_only), BRIDGE_SCHEMA)


def object_store(bridge: DataFrame) -> DataFrame:
    """Each distinct node once: object_id, its canonical body, and how often it occurs."""
    return bridge.groupBy("object_id").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "steps")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return occurrences(_steps(spark, d), objects_only=True).select("step_uid", "field", "path", "parent_path")


def p6_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Parent-child links of all nodes with the trace of the step."""
    return occurrences(_steps(spark, d)).select("trace_id", "step_uid", "field", "kind", "path", "parent_path", "ordinal", "depth", "object_id", "parent_id")


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    """The store of distinct nodes."""
    return object_store(occurrences(_steps(spark, d)))


QUERIES = {"p6_found": p6_found, "p6_bridge": p6_bridge, "p6_objects": p6_objects}
# a JSON string that holds JSON is read through once; what the engine's parser takes beyond JSON (NaN, closing commas) is left out
_JSON = r"""(s is not null and json_valid(s) and not regexp_matches(regexp_replace(s, '"(?:[^"\\]|\\.)*"', '""', 'g'), 'NaN|Infinity|,\s*[\]}]'))"""
_NODES = f"""with recursive once as (select * from (select step_uid, dependencies_json, tool_output_json, state_snapshot_json, row_number() over (partition by step_uid order by ingested_at nulls first, dependencies_json nulls first, tool_output_json nulls first, state_snapshot_json nulls first) k from steps) where k = 1),
u as (select step_uid, 'dependencies_json' field, dependencies_json s from once union all select step_uid, 'tool_output_json', tool_output_json from once union all select step_uid, 'state_snapshot_json', state_snapshot_json from once),
j as (select step_uid, field, case when {_JSON} then s end s from u), w as (select step_uid, field, s, case when json_type(s) = 'VARCHAR' then json_extract_string(s, '$') end t from j where s is not null),
v as (select step_uid, field, case when {_JSON.replace('s is', 't is').replace('(s)', '(t)').replace('(s,', '(t,')} then t else s end::json v from w),
n as (select step_uid, field, '' path, '' parent_path, v, 0 depth from v union all
  select n.step_uid, n.field, case when json_type(n.v) = 'ARRAY' then n.path || '[' || e.key || ']' when n.path = '' then e.key else n.path || '.' || e.key end,
    case when json_type(n.v) = 'OBJECT' or n.depth = 0 then n.path else n.parent_path end, e.value, n.depth + 1 from n, lateral json_each(n.v) e where json_type(n.v) in ('OBJECT', 'ARRAY'))
"""
SQL = {"p6_found": _NODES + "select step_uid, field, path, parent_path from n where depth > 0 and json_type(v) = 'OBJECT'"}

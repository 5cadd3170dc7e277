"""Problem 7: splits that keep related records together.

Records that share an entity (a problem: same domain and problem id, however spelt; other keys, such as
an author or a source, may be named too) form a component. Each component has a profile: its size, its
dominant label and its records in each split of today. Components whose profile spans several splits
are torn today. For the new splits, components of equal size and label are bundled; a min-cost flow sends
the records of each label's bundles to train, validation and test, where staying within a split's quota of
a label is free and going beyond it costs what it deviates. Bundles of one label have the same costs, so
the flow runs over labels and is shared out to bundles in proportion, rounded to whole components with
what is left over carried on from larger to smaller ones. The members of a bundle are told apart by their
hash, so an assignment is repeatable and needs no order of rows.

Scale: components of one key come from one aggregation with map-side combine, those of several keys by
repeated neighbour minima over entities. Only bundles reach the driver; of N records with L labels there
are at most sqrt(2 N L), since different sizes add up (a million for 10^11 records and six labels).
Members are ranked by range-partitioned stretches, so that no task ever holds a whole bundle.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.splits_overlap import components
from failscope.operators.windows import prefix_sums
from failscope.session import checkpointed, require, table, trim_all

SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.8, 0.1, 0.1)


def canonical_split(col):
    """train, validation (also called dev) or test in any spelling; else null."""
    s = F.lower(trim_all(col))
    return F.when(s.isin("dev", "validation", "val"), "validation").when(s.isin("train", "test"), s)


def canonical_problem(domain, problem_id):
    """Domain and problem id without letter case, white space, separators and leading zeros; null if either is missing."""
    d = F.regexp_replace(F.lower(domain), r"[^\p{L}\p{N}]", "")
    p = F.regexp_replace(F.regexp_replace(F.lower(problem_id), r"[^\p{L}\p{N}]", "_"), r"(?<![0-9])0+(?=[0-9])", "")
    p = F.regexp_replace(p, "_", "")
    return F.when((F.length(d) > 0) & (F.length(p) > 0), F.concat_ws("/", d, p))


def labelled(labels: DataFrame) -> DataFrame:
    """(trace_id, split, problem, label): one row a trace, its earliest."""
    rows = require(labels, "trace_id", "split", "problem_id", "domain", "action_label", "ingested_at").filter("trace_id is not null")
    first = rows.groupBy("trace_id").agg(F.min_by(F.struct("split", "problem_id", "domain", "action_label"), F.struct("ingested_at", "split", "problem_id", "domain")).alias("r"))
    return first.select("trace_id", canonical_split(F.col("r.split")).alias("split"), canonical_problem(F.col("r.domain"), F.col("r.problem_id")).alias("problem"), F.col("r.action_label").alias("label"))


def with_components(rows: DataFrame, keys: tuple[str, ...] = ("problem",), id_col: str = "trace_id") -> DataFrame:
    """`rows` with `component`: equal for records that share a value of any of `keys`, directly or through others.

    Null values link nothing; a record without any value is a component of its own.
    """
    own = F.concat(F.lit("#"), F.col(id_col))
    values = [F.when(F.col(k).isNotNull(), F.concat_ws("=", F.lit(k), F.col(k).cast("string"))) for k in keys]
    if len(keys) == 1:
        return rows.withColumn("component", F.coalesce(values[0], own))
    # a graph of entities: a record links its first value with its others
    held = rows.select(F.array_compact(F.array(*values)).alias("v")).filter(F.size("v") > 0).distinct()
    entities = held.select(F.explode("v").alias("key")).distinct()
    links = held.filter(F.size("v") > 1).select(F.col("v")[0].alias("key_a"), F.explode(F.slice("v", 2, len(keys))).alias("key_b")).distinct()
    classes = components(entities, links).select(F.col("key").alias("entity_"), F.col("class_id").alias("class_"))
    return rows.withColumn("entity_", F.coalesce(*values)).join(classes, "entity_", "left").withColumn("component", F.coalesce("class_", own)).drop("entity_", "class_")


def profiles(keyed: DataFrame) -> DataFrame:
    """(component, size, label, n_train, n_validation, n_test): records, dominant label, and records in each split of today."""
    counts = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    per_label = keyed.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), *counts)
    sums = [F.sum(f"n_{s}").alias(f"n_{s}") for s in SPLITS]
    return per_label.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", F.coalesce("label", F.lit("")))).alias("label"), *sums)


def torn_records(rows: DataFrame, keys: tuple[str, ...] = ("problem",)) -> DataFrame:
    """The records of `labelled` with a split whose component also has a record in another split.

    Defined results: records without a split or without any key take no part.
    """
    keyed = with_components(rows.filter("split is not null").filter(F.coalesce(*keys).isNotNull()), keys)
    spans = sum((F.col(f"n_{s}") > 0).cast("int") for s in SPLITS)
    return keyed.join(profiles(keyed).filter(spans > 1).select("component"), "component", "left_semi")


def _min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximal flow: shortest augmenting paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        graph[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        graph[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        far = [float("inf")] * n
        via = [-1] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0:
                    nd = d + cost[e] + potential[u] - potential[to[e]]
                    if nd < far[to[e]]:
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if via[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        push, v = float("inf"), sink
        while v != source:
            push = min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def allocate(bundles: list[tuple[int, str | None, int]], proportions=PROPORTIONS) -> list[list[int]]:
    """Components of each bundle (size, label, number) for each split, summing to the number.

    A flow from labels over (label, split) nodes to splits; within its quota a node's arc is free,
    beyond it costs 1 a record at a node and 3 at a split. Each bundle takes its part of its label's flow;
    what larger components left lacking in a split is made up by smaller ones, and fractions are rounded by size.
    """
    k = len(proportions)
    labels = sorted({str(b[1]) for b in bundles})
    totals = {x: 0 for x in labels}
    for size, label, n in bundles:
        totals[str(label)] += size * n
    total = sum(totals.values())
    n_labels = len(labels)
    node = {(x, s): 1 + n_labels + i * k + s for i, x in enumerate(labels) for s in range(k)}
    split_node = [1 + n_labels * (k + 1) + s for s in range(k)]
    sink = split_node[-1] + 1
    arcs: list[tuple[int, int, int, int]] = []
    choice: list[tuple[int, str, int]] = []
    for i, x in enumerate(labels):
        arcs.append((0, 1 + i, totals[x], 0))
        for s in range(k):
            choice.append((len(arcs), x, s))
            arcs.append((1 + i, node[x, s], totals[x], 0))
    for (x, s), v in node.items():
        quota = round(proportions[s] * totals[x])
        arcs += [(v, split_node[s], quota, 0), (v, split_node[s], totals[x], 1)]
    for s in range(k):
        arcs += [(split_node[s], sink, round(proportions[s] * total), 0), (split_node[s], sink, total, 3)]
    flow = _min_cost_flow(sink + 1, arcs, 0, sink)
    share = {(x, s): flow[arc] / totals[x] for arc, x, s in choice}
    out = [[0] * k for _ in bundles]
    lack = {x: [0.0] * k for x in [*labels, None]}  # None: what labels lacked after their last bundle, taken over by the next bundle of any
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], str(bundles[i][1])))
    last = {str(bundles[i][1]): i for i in order}
    for i in order:
        size, label, n = bundles[i]
        x = str(label)
        want = [max(0.0, share[x, s] * n * size + lack[x][s] + lack[None][s]) for s in range(k)]
        due = [share[x, s] * n * size + lack[x][s] + lack[None][s] for s in range(k)]
        want = [w * n / sum(want) if sum(want) else n * proportions[s] for s, w in enumerate(want)]
        out[i] = [int(w + 1e-9) for w in want]
        for s in sorted(range(k), key=lambda s: (out[i][s] - want[s], -proportions[s]))[: n - sum(out[i])]:
            out[i][s] += 1
        lack[None] = [0.0] * k
        lack[None if last[x] == i else x] = [due[s] - out[i][s] * size for s in range(k)]
    return out


def assign_splits(rows: DataFrame, proportions=PROPORTIONS, keys: tuple[str, ...] = ("problem",)) -> DataFrame:
    """(trace_id, problem, new_split) of every row of `labelled`; a record without a problem is a component of its own.

    Defined results: proportions are met as far as whole components allow, the larger the data the
    closer; ties of hash are broken by the component's key.
    """
    keyed = with_components(rows, keys)
    comps = profiles(keyed).select("component", "size", "label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("label_key"), F.xxhash64("component").alias("h"))
    comps = checkpointed(comps)
    bundles = [(int(r[0]), r[1], int(r[2]), r[3]) for r in comps.groupBy("size", "label", "label_key").agg(F.count(F.lit(1)).alias("n")).orderBy("size", "label_key").select("size", "label", "n", "label_key").toLocalIterator()]
    shares = allocate([b[:3] for b in bundles], proportions) if bundles else []
    bounds = [(z, key, sum(sh[:s]), sum(sh[: s + 1]), SPLITS[s]) for (z, _, _, key), sh in zip(bundles, shares) for s in range(len(sh)) if sh[s]]
    bounds = rows.sparkSession.createDataFrame(bounds, "size bigint, label_key string, lo bigint, hi bigint, new_split string")
    ranked = prefix_sums(comps.drop("label"), ["size", "label_key"], ["h", "component"], [])
    placed = ranked.join(bounds, ["size", "label_key"]).filter((F.col("k") > F.col("lo")) & (F.col("k") <= F.col("hi"))).select("component", "new_split")
    return keyed.join(placed, "component").select("trace_id", "problem", "new_split")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return torn_records(labelled(table(spark, d, "triage_labels"))).select("trace_id")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(labelled(table(spark, d, "triage_labels"))).select("trace_id", "new_split")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records per new split and how many problems it tears apart (none)."""
    a = assign_splits(labelled(table(spark, d, "triage_labels")))
    torn = a.filter("problem is not null").groupBy("problem").agg(F.count_distinct("new_split").alias("n")).filter("n > 1")
    return a.groupBy("new_split").agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(torn.agg(F.count(F.lit(1)).alias("n_torn")))


QUERIES = {"p7_found": p7_found, "p7_assignment": p7_assignment, "p7_shares": p7_shares}

_ROWS = r"""
with first as (select distinct on (trace_id) trace_id, split, domain, problem_id from triage_labels where trace_id is not null order by trace_id, ingested_at, split, problem_id, domain),
rows as (select trace_id,
  case when lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) in ('dev', 'validation', 'val') then 'validation' when lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) in ('train', 'test') then lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) end split,
  nullif(regexp_replace(lower(domain), '[^\p{L}\p{N}]', '', 'g'), '') d,
  nullif(regexp_replace(regexp_replace(lower(problem_id), '[^\p{L}\p{N}]', '', 'g'), '^([a-z]*[0-9]+[a-z]+|[a-z]*)0+([0-9])', '\1\2'), '') p from first)
"""
SQL = {
    "p7_found": _ROWS + "select trace_id from rows where split is not null and d is not null and p is not null and (d, p) in (select (d, p) from rows where split is not null group by d, p having count(distinct split) > 1)",
}

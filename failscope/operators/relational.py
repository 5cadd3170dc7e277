"""Aggregates and joins over the run tables (declarative: Catalyst picks the physical plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators.windows import last_wins
from failscope.session import table


def ratio(num, den, scale: int = 6):
    """Rounded quotient; null where the divisor is zero or null."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), scale)


def one_per_key(spark: SparkSession, d: str, name: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The latest row of each key of a table; later ingested_at wins (see windows.last_wins). Only the named columns are read and shuffled."""
    return last_wins(table(spark, d, name).select(*dict.fromkeys([key, "ingested_at", *columns])), [key], ["ingested_at"])


def traces(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(spark, d, "traces", "trace_id", columns)


def labels(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(spark, d, "triage_labels", "trace_id", columns)


def steps(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(spark, d, "steps", "step_uid", columns)


def runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(spark, d, "runs", "run_id", columns)


# aggregates


def trace_accuracy_by_group(spark, d):
    return traces(spark, d, "benchmark", "success").groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("success") == 1).cast("int")).alias("n_success"), F.round(F.avg((F.col("success") == 1).cast("double")), 3).alias("accuracy"))


def vote_crosstab(spark, d):
    return labels(spark, d, "llm_1_action", "is_local_repairable").groupBy("llm_1_action", "is_local_repairable").agg(F.count(F.lit(1)).alias("n"))


def ablation_counts(spark, d):
    return runs(spark, d, "is_ablation", "ablation_type").groupBy("is_ablation", "ablation_type").agg(F.count(F.lit(1)).alias("n"))


def table_counts(spark, d):
    names = ["runs", "traces", "triage_labels", "steps", "human_vs_llm_audit", "dev", "tombstones"]
    parts = [table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ratio_of_sums(spark, d):
    """Ratio of sums and mean of ratios by group; a zero divisor gives null."""
    r = runs(spark, d, "benchmark", "num_passing_traces", "num_traces_stored", "total_experiment_time_minutes")
    share = F.try_divide(F.sum("num_passing_traces").cast("double") * 100.0, F.sum("num_traces_stored").cast("double"))
    return r.groupBy("benchmark").agg(F.round(share, 1).alias("pct_passing"), F.round(F.avg("total_experiment_time_minutes"), 3).alias("avg_minutes"))


def two_level_max(spark, d):
    """Maximum per trace and step type, then conditional sums: an aggregate of an aggregate."""
    inner = steps(spark, d, "trace_id", "step_type", "text", "tool_call_result").groupBy("trace_id", "step_type").agg(F.max(F.length("text")).alias("longest"), F.max("tool_call_result").alias("any_ok"))
    return inner.groupBy("step_type").agg(F.count(F.lit(1)).alias("n_traces"), F.sum(F.coalesce(F.col("any_ok"), F.lit(0))).alias("n_with_success"), F.sum((F.col("longest") > 100).cast("int")).alias("n_long"))


def scalar_residual(spark, d):
    """Scalar aggregates of two tables and what is left between them."""
    t = traces(spark, d, "is_failing_trace").agg(F.sum((F.col("is_failing_trace") == 1).cast("int")).alias("failing"))
    lab = labels(spark, d).agg(F.count(F.lit(1)).alias("labelled"))
    return t.crossJoin(lab).withColumn("unlabelled", F.col("failing") - F.col("labelled"))  # one row by one row


def group_median(spark, d):
    """Exact median of a length ratio; missing values count as zero."""
    r = traces(spark, d, "domain", "final_answer", "gold_answer").select("domain", F.coalesce(F.try_divide(F.length("final_answer").cast("double"), F.length("gold_answer").cast("double")), F.lit(0.0)).alias("r"))
    return r.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 4).alias("mean_ratio"), F.round(F.median("r"), 4).alias("median_ratio"))


def value_counts(spark, d):
    return labels(spark, d, "action_label").groupBy("action_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "action_label")


def representative_row(spark, d):
    """One row a trace with the columns of its first step: a deterministic pick where SQL dialects would take any row."""
    s = steps(spark, d, "trace_id", "text", "step_type", "tool_name", "step_index").filter("text is not null")
    first = F.min_by(F.struct("step_uid", "step_type", "tool_name"), F.struct("step_index", "step_uid"))
    return s.groupBy("trace_id").agg(first.alias("r")).select("trace_id", "r.step_uid", "r.step_type", "r.tool_name")


def distinct_counts(spark, d):
    return labels(spark, d, "action_label", "domain").agg(F.count_distinct("action_label").alias("n_labels"), F.count_distinct("domain").alias("n_domains"), F.count_distinct("trace_id").alias("n_traces"))


def grouping_sets(spark, d):
    """Totals, per tool and per step type in one pass over the data."""
    s = steps(spark, d, "step_type", "tool_name", "text").select("step_type", "tool_name", F.length("text").alias("len"))
    # null tools are a group of their own, so groupings are told apart by grouping_id
    out = s.groupingSets([[], ["step_type"], ["tool_name"]], "step_type", "tool_name").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("total_len"))
    return out.select("step_type", "tool_name", "level", "n", "total_len")


def step_features(spark, d):
    """Counts by type, tool flags, failure rate and lengths per trace, in one aggregation."""
    s = steps(spark, d, "trace_id", "step_type", "has_tool", "tool_name", "tool_call_result", "text")
    n = F.count(F.lit(1))
    flag = lambda c: F.sum(c.cast("int"))
    tool = (F.coalesce(F.col("has_tool"), F.lit(0)) == 1) | F.col("tool_name").isNotNull()
    failed = F.coalesce(F.col("tool_call_result") == 0, F.lit(False))
    length = F.coalesce(F.length("text"), F.lit(0))
    return s.groupBy("trace_id").agg(
        n.alias("n_steps"), flag(F.col("step_type") == "reasoning").alias("n_reasoning"), flag(F.col("step_type") == "tool_call").alias("n_tool_calls"),
        flag(F.col("step_type") == "tool_response").alias("n_tool_responses"), flag(F.col("step_type") == "final_answer").alias("n_final"),
        flag(tool).alias("n_tool_steps"), flag(failed).alias("n_failed"), F.coalesce(ratio(flag(failed), flag(tool)), F.lit(0.0)).alias("failure_rate"),
        F.round(F.avg(length), 4).alias("avg_len"), F.max(length).alias("max_len"),
    )


# joins


def inner_join_labels(spark, d):
    """Labelled, failing, not an ablation: filters reach both scans."""
    lab = labels(spark, d, "domain", "problem_id", "needs_labeling", "is_ablation").filter("needs_labeling = 1 and is_ablation = 0").select("trace_id", "domain", "problem_id")
    t = traces(spark, d, "num_steps", "is_failing_trace").filter("is_failing_trace = 1").select("trace_id", "num_steps")
    return lab.join(t, "trace_id")


def left_join_best(spark, d):
    """All failing traces with one representative failed tool step, where there is one."""
    best = steps(spark, d, "trace_id", "tool_call_result", "tool_name", "step_index").filter("tool_call_result = 0").groupBy("trace_id").agg(F.min_by(F.struct("step_uid", "tool_name"), F.struct("step_index", "step_uid")).alias("b"))
    return traces(spark, d, "is_failing_trace").filter("is_failing_trace = 1").select("trace_id").join(best, "trace_id", "left").select("trace_id", F.col("b.step_uid").alias("step_uid"), F.col("b.tool_name").alias("tool_name"))


def nested_steps(spark, d):
    """1:N attach: the ordered step types of each trace; traces without steps have an empty text."""
    s = steps(spark, d, "trace_id", "step_index", "step_type").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step_uid", "step_type"))).alias("a"))
    joined = traces(spark, d).select("trace_id").join(s, "trace_id", "left")
    return joined.select("trace_id", F.coalesce(F.array_join(F.transform("a", lambda x: x["step_type"]), ">"), F.lit("")).alias("step_types"), F.coalesce(F.size("a"), F.lit(0)).alias("n_steps"))


def semi_join_ids(spark, d):
    return traces(spark, d, "domain").join(table(spark, d, "dev").select("trace_id"), "trace_id", "left_semi").select("trace_id", "domain")


def anti_join_pending(spark, d):
    """Failing traces not yet labelled."""
    return traces(spark, d, "is_failing_trace").filter("is_failing_trace = 1").join(labels(spark, d).select("trace_id"), "trace_id", "left_anti").select("trace_id")


def anti_join_pairs(spark, d):
    """(trace, action) pairs not yet done: every applicable action of a label less the ones recorded as llm or human actions."""
    lab = labels(spark, d, "applicable_actions_json", "llm_1_action", "llm_2_action", "human_action")
    wanted = lab.select("trace_id", F.explode(F.from_json("applicable_actions_json", "array<string>")).alias("action"))
    done = lab.select("trace_id", F.explode(F.array("llm_1_action", "llm_2_action", "human_action")).alias("action")).filter("action is not null")
    return wanted.join(done, ["trace_id", "action"], "left_anti").groupBy("action").agg(F.count(F.lit(1)).alias("n_pending"))


def lookup_override(spark, d):
    """Inner lookup against a frozen label table that overrides the stored label."""
    frozen = table(spark, d, "dev").filter("human_majority is not null").groupBy("trace_id").agg(F.min("human_majority").alias("frozen"))
    return labels(spark, d, "action_label").join(frozen, "trace_id").select("trace_id", "action_label", F.col("frozen").alias("label"), F.lit("dev").alias("split"))


def priority_merge(spark, d):
    """First source wins, the second fills, in key order; what neither has is marked."""
    lab = labels(spark, d, "human_action", "llm_1_action")
    picked = F.coalesce(F.when(F.col("human_action").isNotNull(), F.struct(F.col("human_action").alias("action"), F.lit("human").alias("src"))), F.when(F.col("llm_1_action").isNotNull(), F.struct(F.col("llm_1_action").alias("action"), F.lit("llm").alias("src"))), F.struct(F.lit(None).cast("string").alias("action"), F.lit("none").alias("src")))
    return lab.select("trace_id", picked.alias("p")).select("trace_id", "p.action", "p.src")


def positional_join(spark, d):
    """Row i of one file with row i of another: explicit ordinals by key order, joined on the ordinal."""
    # a stated order over a table of labels; the rank is exact, from partition counts (windows.dense_ordinals)
    from failscope.operators.windows import ordinals

    a = ordinals(labels(spark, d, "action_label").select("trace_id", "action_label"), ["trace_id"])
    b = ordinals(table(spark, d, "dev").groupBy("trace_id").agg(F.min("human_majority").alias("human_majority")).withColumnRenamed("trace_id", "dev_id"), ["dev_id"])
    return a.join(b, "ordinal").select("ordinal", "trace_id", "dev_id", "human_majority")


def split_union(spark, d):
    """UNION ALL of two label sets, duplicates kept, counted by source."""
    human = labels(spark, d, "human_action", "is_auto_labeled").filter("human_action is not null").select("trace_id", F.col("human_action").alias("label"), F.lit("human").alias("src"))
    auto = labels(spark, d, "human_action", "is_auto_labeled").filter("is_auto_labeled = 1").select("trace_id", F.lit("LOCAL_REPAIR").alias("label"), F.lit("auto").alias("src"))
    return human.unionByName(auto).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, d):
    """Sizes of union, intersection and difference of two key sets."""
    a, b = labels(spark, d).select("trace_id").distinct(), table(spark, d, "dev").select("trace_id").distinct()
    n = lambda df, name: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


def run_children(spark, d):
    """Declared counts of a run against its stored children."""
    kids = traces(spark, d, "run_id", "is_passing_trace").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_found"), F.sum(F.coalesce(F.col("is_passing_trace"), F.lit(0))).alias("n_passing"))
    return runs(spark, d, "num_traces_stored").join(kids, "run_id", "left").filter("num_traces_stored is not null and n_found is distinct from num_traces_stored").select("run_id", "num_traces_stored", "n_found", "n_passing")


def segment_revenue(spark, d):
    """Co-located fact joins on a star schema: filters and columns reach the scans, partial aggregates before the shuffle."""
    o = table(spark, d, "orders").filter("o_orderdate < '1996-01-01'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


QUERIES = {f.__name__: f for f in (
    trace_accuracy_by_group, vote_crosstab, ablation_counts, table_counts, ratio_of_sums, two_level_max, scalar_residual, group_median, value_counts, representative_row,
    distinct_counts, grouping_sets, step_features, inner_join_labels, left_join_best, nested_steps, semi_join_ids, anti_join_pending, anti_join_pairs, lookup_override,
    priority_merge, positional_join, split_union, set_operations, run_children, segment_revenue,
)}

#: one row a key, the latest; the order is the one of windows.last_wins
LATEST = """
with t as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from traces) where rn_ = 1),
l as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from triage_labels) where rn_ = 1),
s as (select * from (select *, row_number() over (partition by step_uid order by ingested_at desc nulls last) rn_ from steps) where rn_ = 1),
r as (select * from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last) rn_ from runs) where rn_ = 1)
"""
_BODY = {
    "trace_accuracy_by_group": "select benchmark, count(*) n, sum(cast(success = 1 as int)) n_success, round(avg(cast(cast(success = 1 as int) as double)), 3) accuracy from t group by 1",
    "vote_crosstab": "select llm_1_action, is_local_repairable, count(*) n from l group by 1, 2",
    "ablation_counts": "select is_ablation, ablation_type, count(*) n from r group by 1, 2",
    "table_counts": " union all ".join(f"select '{n}' table_name, count(*) n_rows from {n}" for n in ("runs", "traces", "triage_labels", "steps", "human_vs_llm_audit", "dev", "tombstones")),
    "ratio_of_sums": "select benchmark, round(sum(num_passing_traces) * 100.0 / nullif(sum(num_traces_stored), 0), 1) pct_passing, round(avg(total_experiment_time_minutes), 3) avg_minutes from r group by 1",
    "two_level_max": "select step_type, count(*) n_traces, sum(coalesce(any_ok, 0)) n_with_success, sum(cast(longest > 100 as int)) n_long from (select trace_id, step_type, max(length(text)) longest, max(tool_call_result) any_ok from s group by 1, 2) group by 1",
    "scalar_residual": "select failing, labelled, failing - labelled unlabelled from (select sum(cast(is_failing_trace = 1 as int)) failing from t), (select count(*) labelled from l)",
    "group_median": "select domain, count(*) n, round(avg(x), 4) mean_ratio, round(median(x), 4) median_ratio from (select domain, coalesce(length(final_answer) * 1.0 / nullif(length(gold_answer), 0), 0.0)::double x from t) group by 1",
    "value_counts": "select action_label, count(*) n from l group by 1",
    "representative_row": "select trace_id, step_uid, step_type, tool_name from (select *, row_number() over (partition by trace_id order by step_index nulls first, step_uid) k from s where text is not null) where k = 1",
    "distinct_counts": "select count(distinct action_label) n_labels, count(distinct domain) n_domains, count(distinct trace_id) n_traces from l",
    "grouping_sets": "select step_type, tool_name, grouping(step_type, tool_name) \"level\", count(*) n, sum(length(text)) total_len from s group by grouping sets ((), (step_type), (tool_name))",
    "step_features": """select trace_id, count(*) n_steps, sum(cast(step_type = 'reasoning' as int)) n_reasoning, sum(cast(step_type = 'tool_call' as int)) n_tool_calls,
      sum(cast(step_type = 'tool_response' as int)) n_tool_responses, sum(cast(step_type = 'final_answer' as int)) n_final, sum(cast(tool as int)) n_tool_steps, sum(cast(failed as int)) n_failed,
      coalesce(round(sum(cast(failed as int)) * 1.0 / nullif(sum(cast(tool as int)), 0), 6), 0.0) failure_rate, round(avg(len), 4) avg_len, max(len) max_len
      from (select *, coalesce(has_tool, 0) = 1 or tool_name is not null tool, coalesce(tool_call_result = 0, false) failed, coalesce(length(text), 0) len from s) group by 1""",
    "inner_join_labels": "select trace_id, l.domain, l.problem_id, t.num_steps from l join t using (trace_id) where needs_labeling = 1 and l.is_ablation = 0 and t.is_failing_trace = 1",
    "left_join_best": "select t.trace_id, b.step_uid, b.tool_name from t left join (select * from (select *, row_number() over (partition by trace_id order by step_index nulls first, step_uid) k from s where tool_call_result = 0) where k = 1) b using (trace_id) where is_failing_trace = 1",
    "nested_steps": "select t.trace_id, coalesce(x.st, '') step_types, coalesce(x.n, 0) n_steps from t left join (select trace_id, string_agg(step_type, '>' order by step_index nulls first, step_uid) st, count(*) n from s group by 1) x using (trace_id)",
    "semi_join_ids": "select trace_id, domain from t where trace_id in (select trace_id from dev)",
    "anti_join_pending": "select trace_id from t where is_failing_trace = 1 and trace_id not in (select trace_id from l where trace_id is not null)",
    "anti_join_pairs": """select action, count(*) n_pending from (select trace_id, unnest(cast(applicable_actions_json as json)::varchar[]) action from l) w
      where not exists (select 1 from l x where x.trace_id = w.trace_id and w.action in (x.llm_1_action, x.llm_2_action, x.human_action)) group by 1""",
    "lookup_override": "select trace_id, action_label, f.frozen as label, 'dev' as split from l join (select trace_id, min(human_majority) frozen from dev where human_majority is not null group by 1) f using (trace_id)",
    "priority_merge": "select trace_id, coalesce(human_action, llm_1_action) as action, case when human_action is not null then 'human' when llm_1_action is not null then 'llm' else 'none' end src from l",
    "positional_join": "select a.ordinal, a.trace_id, b.dev_id, b.human_majority from (select trace_id, row_number() over (order by trace_id) ordinal from l) a join (select trace_id dev_id, min(human_majority) human_majority, row_number() over (order by trace_id) ordinal from dev group by trace_id) b using (ordinal)",
    "split_union": "select src, label, count(*) n from (select human_action as label, 'human' src from l where human_action is not null union all select 'LOCAL_REPAIR', 'auto' from l where is_auto_labeled = 1) group by 1, 2",
    "set_operations": "select 'union' op, count(*) n from (select trace_id from l union select trace_id from dev) union all select 'intersect', count(*) from (select trace_id from l intersect select trace_id from dev) union all select 'except', count(*) from (select trace_id from l except select trace_id from dev)",
    "run_children": "select run_id, num_traces_stored, n_found, n_passing from r left join (select run_id, count(*) n_found, sum(coalesce(is_passing_trace, 0)) n_passing from t group by 1) k using (run_id) where num_traces_stored is not null and n_found is distinct from num_traces_stored",
    "segment_revenue": "select c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(distinct o_orderkey) n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderdate < timestamp '1996-01-01' group by 1",
}
SQL = {k: (q if k in ("table_counts", "segment_revenue") else LATEST + q) for k, q in _BODY.items()}

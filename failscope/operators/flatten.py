"""Nested run documents to eight flat tables.

A document is a variant, so fields of changing shape need no schema and an absent key differs from
a null. Every table is a chain of explodes and field reads over the documents, without a shuffle; the
only one is the last-wins aggregation that makes keys unique. JSON columns hold compact JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.functions.text import ablation_of, benchmark_of, domain_of, exact_match
from failscope.operators.windows import last_wins


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def has(v: Column, key: str) -> Column:
    """The key is there, be its value null or not."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def as_json(v: Column, path: str) -> Column:
    """Compact JSON of a value; null for an absent key and for null."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(x.isNotNull() & ~F.is_variant_null(x), F.to_json(x))


def as_text(v: Column, path: str) -> Column:
    """A text as it is, another value as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING", get(v, path)), as_json(v, path))


def flag(v: Column, path: str) -> Column:
    return get(v, path, "boolean").cast("int")


def printed(col: Column) -> Column:
    """Parts of keys print a missing value as None."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def run_documents(raw: DataFrame, include_ablations: bool = True) -> DataFrame:
    """Documents (doc, source_file, ordinal) as variants `v`, with what every table needs of the run."""
    v = F.try_parse_json("doc")
    df = raw.select(v.alias("v"), "source_file", "ordinal").filter("v is not null")
    name = get(F.col("v"), "experiment_name")
    df = df.select("v", "source_file", "ordinal", get(F.col("v"), "run_id").alias("run_id"), name.alias("experiment_name"), benchmark_of(name).alias("benchmark"), domain_of(benchmark_of(name)).alias("domain"), F.coalesce(name.startswith("ablation_"), F.lit(False)).cast("int").alias("is_ablation"), ablation_of(name).alias("ablation_type"))
    return df if include_ablations else df.filter("is_ablation = 0")


def runs(docs: DataFrame) -> DataFrame:
    v = F.col("v")
    n = lambda k: F.coalesce(F.size(get(v, k, "array<variant>")), F.lit(0))
    stat = lambda k: get(v, f"stats.{k}", "bigint").alias(f"stats_{k}")
    out = docs.select(
        "run_id", "experiment_name", "benchmark", "domain", "is_ablation", "ablation_type", get(v, "ablation_target").alias("ablation_target"), get(v, "timestamp").alias("timestamp"),
        get(v, "model_used").alias("model_used"), get(v, "num_problems", "bigint").alias("num_problems_declared"), (n("passing_traces") + n("failing_traces")).cast("bigint").alias("num_traces_stored"),
        n("passing_traces").cast("bigint").alias("num_passing_traces"), n("failing_traces").cast("bigint").alias("num_failing_traces"), stat("total"), stat("passing"), stat("failing"), stat("fixed"),
        get(v, "stats.accuracy", "double").alias("stats_accuracy"), get(v, "stats.total_experiment_time_minutes", "double").alias("total_experiment_time_minutes"), "source_file", "ordinal",
    )
    return last_wins(out, ["run_id"], ["source_file", "ordinal"]).drop("ordinal")


def _traces(docs: DataFrame) -> DataFrame:
    """One row a stored trace, passing ones first, in the order of the document."""
    base = ["run_id", "benchmark", "domain", "is_ablation", "ablation_type", "source_file", "ordinal", F.col("v").alias("run")]
    one = lambda key, passing: docs.select(*base, F.posexplode(get(F.col("v"), key, "array<variant>")).alias("pos", "t")).withColumn("is_passing_trace", F.lit(passing))
    both = one("passing_traces", 1).unionByName(one("failing_traces", 0))
    problem = as_text(F.col("t"), "problem_id")
    return both.withColumn("problem_id", problem).withColumn("trace_id", F.concat_ws("::", F.col("run_id"), printed(problem)))


def _field(key: str, kind: str = "string") -> Column:
    """A field of the trace, or of its inner object where the trace lacks the key (a null doesn't fall through)."""
    read = (lambda v, k: as_text(v, k)) if kind == "text" else (lambda v, k: get(v, k, kind))
    t = F.col("t")
    return F.when(has(t, key), read(t, key)).otherwise(read(t, f"trace.{key}"))


def traces(docs: DataFrame) -> DataFrame:
    t = F.col("t")
    gold, final = _field("gold_answer", "text"), _field("final_answer", "text")
    out = _traces(docs).select(
        "trace_id", "run_id", "problem_id", "benchmark", "domain", get(F.col("run"), "model_used").alias("model_used"), "is_ablation", "ablation_type", get(t, "timestamp").alias("timestamp"),
        _field("success", "boolean").cast("int").alias("success"), _field("problem_statement").alias("problem_statement"), gold.alias("gold_answer"), final.alias("final_answer"),
        get(t, "trace.num_steps", "bigint").alias("num_steps"), get(t, "causal_flow_analysis_time_minutes", "double").alias("causal_flow_analysis_minutes"), "is_passing_trace",
        (1 - F.col("is_passing_trace")).alias("is_failing_trace"), exact_match(gold, final).alias("answer_exact_match"), "source_file", "ordinal", "pos",
    )
    order = ["source_file", "ordinal", "is_failing_trace", "pos"]
    return last_wins(out, ["trace_id"], order).drop("source_file", "ordinal", "pos")


def _steps(docs: DataFrame) -> DataFrame:
    s = _traces(docs).select("*", F.posexplode(get(F.col("t"), "trace.steps", "array<variant>")).alias("step_index", "s"))
    step = F.when(has(F.col("s"), "step_id"), get(F.col("s"), "step_id", "bigint")).otherwise(F.col("step_index").cast("bigint"))
    return s.withColumn("step_id", step).withColumn("step_uid", F.concat_ws("::step::", "trace_id", printed(step)))


def steps(docs: DataFrame) -> DataFrame:
    s = F.col("s")
    kind, tool = get(s, "step_type"), get(s, "tool_name")
    is_ = lambda x: F.coalesce(kind == x, F.lit(False)).cast("int")
    out = _steps(docs).select(
        "step_uid", "trace_id", "run_id", "problem_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"), kind.alias("step_type"), as_json(s, "dependencies").alias("dependencies_json"),
        get(s, "text").alias("text"), tool.alias("tool_name"), as_json(s, "tool_args").alias("tool_args_json"), as_json(s, "tool_output").alias("tool_output_json"), flag(s, "tool_call_result").alias("tool_call_result"),
        as_json(s, "state_snapshot").alias("state_snapshot_json"), _field("success", "boolean").cast("int").alias("trace_success"), (F.length(F.coalesce(tool, F.lit(""))) > 0).cast("int").alias("has_tool"),
        is_("reasoning").alias("is_reasoning_step"), is_("tool_call").alias("is_tool_call"), is_("tool_response").alias("is_tool_response"), is_("final_answer").alias("is_final_answer"),
        F.length(F.coalesce(get(s, "text"), F.lit(""))).alias("text_length"), "source_file", "ordinal", (1 - F.col("is_passing_trace")).alias("failing"), "pos",
    )
    return last_wins(out, ["step_uid"], ["source_file", "ordinal", "failing", "pos", "step_index"]).drop("source_file", "ordinal", "failing", "pos")


def _failed(docs: DataFrame) -> DataFrame:
    return _traces(docs).filter("is_passing_trace = 0")


def _entries(v: Column) -> Column:
    """An object's entries, or a list's with their positions as keys, as one array; other values have none."""
    as_map = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    as_list = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.coalesce(as_map, as_list)


def _repairs() -> Column:
    """Successful repairs, else the best ones, else the final ones; empty collections fall through."""
    t = F.col("t")
    found = [_entries(F.try_variant_get(t, f"$.analysis.{p}", "variant")) for p in ("counterfactual_repair.successful_repairs", "counterfactual_repair.best_repairs", "final_repairs")]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])


def repair_attempts(docs: DataFrame) -> DataFrame:
    r = _failed(docs).select("*", F.posexplode(_repairs()).alias("place", "e")).select("*", F.col("e.key").alias("repair_idx"), F.col("e.value").alias("r"))
    r = r.filter(F.schema_of_variant("r").startswith("OBJECT"))  # other values are no repairs
    step = F.when(F.col("repair_idx").rlike("^[0-9]+$"), F.col("repair_idx").try_cast("bigint"))
    v = F.col("r")
    d = lambda k: get(v, k, "double").alias(k)
    out = r.withColumn("step_id", step).withColumn("step_uid", F.concat_ws("::step::", "trace_id", printed(step))).select(
        F.concat_ws("::repair::", "trace_id", "repair_idx").alias("repair_id"), "step_uid", "trace_id", "run_id", "problem_id", "step_id", "repair_idx", flag(v, "success_predicted").alias("success_predicted"),
        F.lit(1).alias("repair_succeeded"), d("minimality_score"), d("minimality_lex"), d("minimality_edit"), d("minimality_sem"), get(v, "original_step.step_type").alias("original_step_type"),
        F.coalesce(get(v, "original_text"), get(v, "original_step.text")).alias("original_text"), F.coalesce(get(v, "repaired_text"), get(v, "repaired_step.text")).alias("repaired_text"),
        get(v, "original_step.tool_name").alias("original_tool_name"), as_json(v, "original_step.tool_args").alias("original_tool_args_json"), get(v, "repaired_step.tool_name").alias("repaired_tool_name"),
        as_json(v, "repaired_step.tool_args").alias("repaired_tool_args_json"), F.to_json("r").alias("raw_repair_json"), "source_file", "ordinal", "pos", "place",
    )
    return last_wins(out, ["repair_id"], ["source_file", "ordinal", "pos", "place"]).drop("source_file", "ordinal", "pos", "place")


def judge_votes(docs: DataFrame) -> DataFrame:
    """Two explodes: candidates of the critique, and the judges of each."""
    c = _failed(docs).select("*", F.explode(F.map_entries(get(F.col("t"), "analysis.multi_agent_critique.critique_details", "map<string,variant>"))).alias("e"))
    c = c.select("trace_id", "run_id", "problem_id", "source_file", "ordinal", "pos", F.col("e.key").alias("candidate_idx"), F.col("e.value").alias("c"))
    step = F.coalesce(get(F.col("c"), "step_id", "bigint"), F.when(F.col("candidate_idx").rlike("^[0-9]+$"), F.col("candidate_idx").try_cast("bigint")))
    j = c.withColumn("step_id", step).select("*", F.posexplode(get(F.col("c"), "judge_ensemble", "array<variant>")).alias("judge_idx", "j"))
    says = F.coalesce(get(F.col("c"), "final_verdict", "boolean"), get(F.col("j"), "agrees", "boolean"), F.lit(False)).cast("int")
    v = F.col("j")
    out = j.withColumn("step_uid", F.concat_ws("::step::", "trace_id", printed(F.col("step_id")))).select(
        F.concat_ws("::", "trace_id", F.lit("vote"), "candidate_idx", F.col("judge_idx").cast("string")).alias("judge_vote_id"), "step_uid", "trace_id", "run_id", "problem_id", "step_id", "candidate_idx",
        get(F.col("c"), "proposed_by").alias("proposed_by"), get(v, "agent").alias("judge_agent"), get(v, "role").alias("judge_role"), flag(v, "agrees").alias("agrees"), get(v, "confidence", "double").alias("confidence"),
        get(v, "reasoning").alias("reasoning"), get(v, "agreement").alias("agreement_text"), get(v, "evidence_strength").alias("evidence_strength"), says.alias("judge_says_causal"), "source_file", "ordinal", "pos",
    )
    fixed = repair_attempts(docs).select("step_uid").distinct().withColumn("r", F.lit(1))
    out = last_wins(out, ["judge_vote_id"], ["source_file", "ordinal", "pos"]).drop("source_file", "ordinal", "pos").join(fixed, "step_uid", "left")
    rep = F.coalesce("r", F.lit(0))
    return out.withColumn("is_repairable_step", rep).withColumn("vote_matches_repairability", (F.col("judge_says_causal") == rep).cast("int")).drop("r")


def consensus_steps(docs: DataFrame) -> DataFrame:
    c = _failed(docs).select("*", F.posexplode(get(F.col("t"), "analysis.multi_agent_critique.consensus_steps", "array<variant>")).alias("place", "c"))
    v = F.col("c")
    step = get(v, "step_id", "bigint")
    out = c.withColumn("step_id", step).withColumn("step_uid", F.concat_ws("::step::", "trace_id", printed(step))).select(
        F.concat_ws("::consensus::", "trace_id", F.col("place").cast("string")).alias("consensus_id"), "step_uid", "trace_id", "run_id", "problem_id", "step_id", get(v, "step_type").alias("step_type"),
        get(v, "consensus_score", "double").alias("consensus_score"), as_text(v, "final_verdict").alias("final_verdict"), get(v, "proposed_by").alias("proposed_by"), get(v, "num_critiques", "bigint").alias("num_critiques"),
        get(v, "final_critic_summary").alias("final_critic_summary"), get(v, "text").alias("text"), get(v, "tool_name").alias("tool_name"), as_json(v, "tool_args").alias("tool_args_json"),
        as_json(v, "dependencies").alias("dependencies_json"), F.to_json("c").alias("raw_consensus_json"), "source_file", "ordinal", "pos",
    )
    fixed = repair_attempts(docs).select("step_uid").distinct().withColumn("r", F.lit(1))
    out = last_wins(out, ["consensus_id"], ["source_file", "ordinal", "pos"]).drop("source_file", "ordinal", "pos").join(fixed, "step_uid", "left")
    return out.withColumn("is_repairable_step", F.coalesce("r", F.lit(0))).withColumn("has_successful_repair", F.coalesce("r", F.lit(0))).drop("r")


def _num_repairs() -> Column:
    declared = get(F.col("t"), "analysis.counterfactual_repair.num_successful_repairs", "bigint")
    return F.coalesce(F.nullif(declared, F.lit(0)), F.size(_repairs()).cast("bigint"), F.lit(0))


def triage_labels(docs: DataFrame) -> DataFrame:
    """Failed traces; those with a successful repair are labelled by it, the rest need a label."""
    repaired = (_num_repairs() > 0).cast("int")
    out = _failed(docs).select(
        "trace_id", "run_id", "problem_id", "benchmark", "domain", "is_ablation", "ablation_type", F.when(repaired == 1, "LOCAL_REPAIR").alias("action_label"), F.when(repaired == 1, "repair").alias("label_source"),
        repaired.alias("is_auto_labeled"), (1 - repaired).alias("needs_labeling"), repaired.alias("is_local_repairable"), _num_repairs().alias("num_successful_repair_steps"), "source_file", "ordinal", "pos",
    )
    later = ("applicable_actions_json", "llm_1_action", "llm_1_rationale", "llm_2_action", "llm_2_rationale", "human_action", "human_rationale", "split")  # filled by labelling
    out = last_wins(out, ["trace_id"], ["source_file", "ordinal", "pos"]).drop("source_file", "ordinal", "pos")
    return out.select("*", *[F.lit(None).cast("string").alias(c) for c in later])


def trace_metrics(docs: DataFrame) -> DataFrame:
    t = F.col("t")
    d = lambda p, a: get(t, f"metrics.{p}", "double").alias(a)
    n = lambda p, a: get(t, f"metrics.{p}", "bigint").alias(a)
    critique = "analysis.multi_agent_critique"
    out = _failed(docs).select(
        "trace_id", "run_id", "problem_id", d("minimality.average", "minimality_average"), d("minimality.min", "minimality_min"), d("minimality.max", "minimality_max"),
        n("attribution.num_identified_causal_steps", "num_identified_causal_steps"), d("attribution.precision", "attribution_precision"), d("attribution.recall", "attribution_recall"), d("attribution.f1_score", "attribution_f1"),
        n("repairs.total_repairs_attempted", "repairs_attempted"), n("repairs.successful_repairs", "repairs_successful"), n("repairs.failed_repairs", "repairs_failed"), d("repairs.success_rate", "repair_success_rate"),
        _num_repairs().alias("num_successful_repair_steps"), F.coalesce(F.size(get(t, f"{critique}.consensus_steps", "array<variant>")), F.lit(0)).alias("num_consensus_steps"), flag(t, f"{critique}.skipped").alias("multi_agent_skipped"),
        get(t, f"{critique}.reason").alias("multi_agent_skip_reason"), as_json(t, "analysis.causal_attribution.causal_steps").alias("causal_steps_json"), as_json(t, "metrics.attribution.identified_steps").alias("identified_steps_json"),
        "source_file", "ordinal", "pos",
    )
    return last_wins(out, ["trace_id"], ["source_file", "ordinal", "pos"]).drop("source_file", "ordinal", "pos")


TABLES = {f.__name__: f for f in (runs, traces, triage_labels, steps, repair_attempts, judge_votes, consensus_steps, trace_metrics)}


def flatten(raw: DataFrame, include_ablations: bool = True) -> dict[str, DataFrame]:
    """All eight tables of (doc, source_file, ordinal) documents."""
    docs = run_documents(raw, include_ablations)
    return {name: f(docs) for name, f in TABLES.items()}


# queries: the stored tables are nested again into documents, and flattened from them


def _stored(spark, d):
    """Traces with a run, one a run and problem, and steps with a number, one a key, as the documents nest them."""
    from failscope.session import table

    t = last_wins(table(spark, d, "traces"), ["trace_id"], ["ingested_at"]).filter("run_id is not null").join(table(spark, d, "runs").select("run_id").distinct(), "run_id", "left_semi")
    keep = ["trace_id", "is_passing_trace", "timestamp", "success", "problem_statement", "gold_answer", "final_answer", "num_steps"]
    t = t.groupBy("run_id", "problem_id").agg(F.min_by(F.struct(*keep), "trace_id").alias("r")).select("run_id", "problem_id", "r.*")
    cols = ["trace_id", "step_index", "step_id", "step_type", "text", "tool_name", "tool_call_result"]
    return t, last_wins(table(spark, d, "steps").select("step_uid", "ingested_at", *cols), ["step_uid"], ["ingested_at"]).select("step_uid", *cols)


def _runs(spark, d):
    from failscope.session import table

    cols = ["experiment_name", "timestamp", "model_used", "num_problems_declared", "stats_total", "stats_accuracy"]
    r = last_wins(table(spark, d, "runs").select("run_id", "ingested_at", *cols), ["run_id"], ["ingested_at"])
    return r.select("run_id", "experiment_name", F.col("timestamp").alias("run_timestamp"), "model_used", F.col("num_problems_declared").alias("num_problems"), F.struct(F.col("stats_total").alias("total"), F.col("stats_accuracy").alias("accuracy")).alias("stats"))


def _raw() -> list[Column]:
    return [F.lit("tables").alias("source_file"), F.lit(0).cast("bigint").alias("ordinal")]


def trace_documents(spark, d) -> DataFrame:
    """A run document for each trace, so no document is larger than a trace. Failed tool steps are its repairs, judged candidates and consensus."""
    t, s = _stored(spark, d)
    bad = F.col("tool_call_result") == 0
    key = F.col("step_id").cast("string")
    step = F.struct("step_type", "tool_name", "text")
    repair = F.struct(F.lit(True).alias("success_predicted"), (1.0 / (1 + F.length(F.coalesce("text", F.lit(""))))).alias("minimality_score"), F.concat(F.lit("again: "), F.coalesce("text", F.lit(""))).alias("repaired_text"), step.alias("original_step"))
    judges = F.array(*[F.struct(F.lit(x).alias("agent"), (F.col("step_id") % n == 0).alias("agrees"), F.lit(n / 4).alias("confidence")) for x, n in (("first", 2), ("second", 3))])
    critique = F.struct("step_id", F.col("tool_name").alias("proposed_by"), judges.alias("judge_ensemble"))
    agreed = F.struct("step_id", "step_type", (F.col("step_id") / 10).alias("consensus_score"), "text")
    listed = lambda c, when: F.array_sort(F.collect_list(F.when(when, c)))
    chosen = bad & F.col("step_id").isNotNull()
    per = s.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("step_index", "step_id", "step_type", "text", "tool_name", "tool_call_result"))).alias("steps"),
        listed(F.struct(key.alias("k"), repair.alias("v")), chosen).alias("repairs"), listed(F.struct(key.alias("k"), critique.alias("v")), chosen).alias("critique"), listed(agreed, chosen).alias("agreed"),
    )
    as_map = lambda c: F.map_from_entries(c)
    analysis = F.struct(
        F.struct(as_map("repairs").alias("successful_repairs")).alias("counterfactual_repair"),
        F.struct(F.lit(False).alias("skipped"), as_map("critique").alias("critique_details"), F.col("agreed").alias("consensus_steps")).alias("multi_agent_critique"),
    )
    n = F.size("repairs")
    metrics = F.struct(F.struct(n.alias("num_identified_causal_steps")).alias("attribution"), F.struct((n + 1).alias("total_repairs_attempted"), n.alias("successful_repairs"), F.lit(1).alias("failed_repairs"), (n / (n + 1)).alias("success_rate")).alias("repairs"))
    trace = F.struct("problem_id", "timestamp", (F.col("success") == 1).alias("success"), "problem_statement", "gold_answer", "final_answer", F.struct("num_steps", "steps").alias("trace"), analysis.alias("analysis"), metrics.alias("metrics"))
    body = t.join(per, "trace_id", "left").withColumn("t", trace)
    side = lambda x: F.when(F.col("is_passing_trace") == x, F.array("t"))
    return body.join(_runs(spark, d), "run_id").select(F.to_json(F.struct("run_id", "experiment_name", "model_used", side(1).alias("passing_traces"), side(0).alias("failing_traces"))).alias("doc"), *_raw())


def run_only_documents(spark, d) -> DataFrame:
    """A document for each run, with the ids of its traces only."""
    t, _ = _stored(spark, d)
    arr = lambda p: F.array_sort(F.collect_list(F.when(F.col("is_passing_trace") == p, F.struct("problem_id"))))
    g = t.groupBy("run_id").agg(arr(1).alias("passing_traces"), arr(0).alias("failing_traces"))
    return _runs(spark, d).join(g, "run_id").select(F.to_json(F.struct("*")).alias("doc"), *_raw())


def _flat(spark, d):
    return run_documents(trace_documents(spark, d))


def flat_runs(spark, d):
    return runs(run_documents(run_only_documents(spark, d))).select("run_id", "num_traces_stored", "num_passing_traces", "num_failing_traces", "stats_accuracy")


def flat_steps(spark, d):
    return steps(_flat(spark, d)).groupBy("step_type").agg(F.count(F.lit(1)).alias("n"), F.sum("text_length").cast("bigint").alias("len"), F.sum("has_tool").cast("bigint").alias("n_tool"), F.count("tool_call_result").alias("n_result"))


def flat_traces(spark, d):
    return traces(_flat(spark, d)).select("trace_id", "run_id", "problem_id", "success", "num_steps", "is_passing_trace", "is_failing_trace", "answer_exact_match", F.length("problem_statement").alias("statement_length"))


def flat_labels(spark, d):
    return triage_labels(_flat(spark, d)).select("trace_id", "action_label", "label_source", "is_auto_labeled", "needs_labeling", "num_successful_repair_steps")


def flat_repairs(spark, d):
    r = repair_attempts(_flat(spark, d))
    return r.select("repair_id", "step_uid", "step_id", "success_predicted", F.round("minimality_score", 6).alias("minimality_score"), "original_step_type", "original_tool_name", F.length("repaired_text").alias("repaired_length"))


def flat_votes(spark, d):
    return judge_votes(_flat(spark, d)).select("judge_vote_id", "step_uid", "proposed_by", "judge_agent", "agrees", "confidence", "judge_says_causal", "is_repairable_step", "vote_matches_repairability")


def flat_consensus(spark, d):
    return consensus_steps(_flat(spark, d)).select("consensus_id", "step_uid", "step_type", F.round("consensus_score", 6).alias("consensus_score"), "is_repairable_step", "has_successful_repair")


def flat_metrics(spark, d):
    m = trace_metrics(_flat(spark, d))
    return m.select("trace_id", "num_identified_causal_steps", "repairs_attempted", "repairs_successful", "repairs_failed", F.round("repair_success_rate", 6).alias("repair_success_rate"), "num_successful_repair_steps", "num_consensus_steps", "multi_agent_skipped")


def metrics_by_benchmark(spark, d):
    """Failed traces with their metrics: mean length and the share of steps that are causal."""
    docs = _flat(spark, d)
    t, m = traces(docs).filter("success = 0").select("trace_id", "benchmark", "num_steps"), trace_metrics(docs).select("trace_id", "num_identified_causal_steps")
    share = F.try_divide(F.sum("num_identified_causal_steps") * 100.0, F.sum("num_steps").cast("double"))
    return t.join(m, "trace_id").groupBy("benchmark").agg(F.count("trace_id").alias("n"), F.round(F.avg("num_steps"), 2).alias("avg_steps"), F.round(share, 1).alias("pct_causal"))


def repair_length_ratio(spark, d):
    """Length of repaired texts against the original ones by benchmark; a missing ratio counts as zero."""
    docs = _flat(spark, d)
    r = repair_attempts(docs).filter("repair_succeeded = 1 and repaired_text is not null")
    x = F.coalesce(F.try_divide(F.length("repaired_text").cast("double"), F.length("original_text").cast("double")), F.lit(0.0))
    j = r.select("trace_id", x.alias("x")).join(traces(docs).select("trace_id", "benchmark"), "trace_id")
    return j.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean_ratio"), F.round(F.median("x"), 4).alias("median_ratio"))


QUERIES = {f.__name__: f for f in (flat_runs, flat_steps, flat_traces, flat_labels, flat_repairs, flat_votes, flat_consensus, flat_metrics, metrics_by_benchmark, repair_length_ratio)}
_T = """with t0 as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) k_ from traces) where k_ = 1 and run_id is not null and run_id in (select run_id from runs)),
t as (select *, run_id || '::' || coalesce(problem_id, 'None') tid from (select *, row_number() over (partition by run_id, problem_id order by trace_id) p_ from t0) where p_ = 1),
s as (select * from (select *, row_number() over (partition by step_uid order by ingested_at desc nulls last) k_ from steps) where k_ = 1),
r as (select * from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last) k_ from runs) where k_ = 1),
ft as (select t.*, case when starts_with(r.experiment_name, 'ablation_') then replace(replace(r.experiment_name, 'ablation_minimality_', ''), 'ablation_nogold_', '') else nullif(r.experiment_name, '') end bench from t join r using (run_id) where is_passing_trace in (0, 1)),
b as (select f.tid, f.bench, f.tid || '::step::' || s.step_id suid, s.step_id, s.step_type, s.tool_name, s.text, s.step_index, row_number() over (partition by f.tid order by s.step_id, s.step_type nulls first) - 1 place from ft f join s using (trace_id) where f.is_passing_trace = 0 and s.tool_call_result = 0 and s.step_id is not null),
nb as (select f.tid, count(b.tid) n from ft f left join b using (tid) where f.is_passing_trace = 0 group by 1)
"""
SQL = {
    "flat_runs": _T + "select run_id, count(*) filter (where is_passing_trace in (0, 1)) num_traces_stored, count(*) filter (where is_passing_trace = 1) num_passing_traces, count(*) filter (where is_passing_trace = 0) num_failing_traces, any_value(stats_accuracy) stats_accuracy from r join t using (run_id) group by 1",
    "flat_steps": _T + ", x as (select distinct on (tid, coalesce(step_id, -1)) tid, s.* from ft f join s using (trace_id) where step_id is not null order by tid, coalesce(step_id, -1)) select step_type, count(*) n, sum(length(coalesce(text, ''))) len, sum(cast(coalesce(tool_name, '') <> '' as int)) n_tool, count(tool_call_result) n_result from x group by 1",
    "flat_traces": _T + r"select tid trace_id, run_id, problem_id, success, num_steps, is_passing_trace, 1 - is_passing_trace is_failing_trace, cast(regexp_replace(gold_answer, '^\s+|\s+$', '', 'g') = regexp_replace(final_answer, '^\s+|\s+$', '', 'g') as int) answer_exact_match, length(problem_statement) statement_length from ft",
    "flat_labels": _T + "select tid trace_id, case when n > 0 then 'LOCAL_REPAIR' end action_label, case when n > 0 then 'repair' end label_source, cast(n > 0 as int) is_auto_labeled, cast(n = 0 as int) needs_labeling, n num_successful_repair_steps from nb",
    "flat_repairs": _T + "select tid || '::repair::' || step_id repair_id, suid step_uid, step_id, 1 success_predicted, round(1.0 / (1 + length(coalesce(text, ''))), 6) minimality_score, step_type original_step_type, tool_name original_tool_name, 7 + length(coalesce(text, '')) repaired_length from b",
    "flat_votes": _T + ", v as (select b.*, j.i, j.agent, j.m from b, (values (0, 'first', 2), (1, 'second', 3)) j(i, agent, m)) select tid || '::vote::' || step_id || '::' || i judge_vote_id, suid step_uid, tool_name proposed_by, agent judge_agent, cast(step_id % m = 0 as int) agrees, m / 4.0 confidence, cast(step_id % m = 0 as int) judge_says_causal, 1 is_repairable_step, cast(step_id % m = 0 as int) vote_matches_repairability from v",
    "flat_consensus": _T + "select tid || '::consensus::' || place consensus_id, suid step_uid, step_type, round(step_id / 10, 6) consensus_score, 1 is_repairable_step, 1 has_successful_repair from b",
    "flat_metrics": _T + "select nb.tid trace_id, case when f.has_steps then n end num_identified_causal_steps, case when f.has_steps then n + 1 end repairs_attempted, case when f.has_steps then n end repairs_successful, 1 repairs_failed, case when f.has_steps then round(n / (n + 1), 6) end repair_success_rate, n num_successful_repair_steps, n num_consensus_steps, 0 multi_agent_skipped from nb join (select tid, trace_id in (select trace_id from s where trace_id is not null) has_steps from ft) f using (tid)",
    "metrics_by_benchmark": _T + "select bench benchmark, count(*) n, round(avg(num_steps), 2) avg_steps, round(sum(case when h then n end) * 100.0 / nullif(sum(num_steps), 0), 1) pct_causal from (select ft.*, trace_id in (select trace_id from s where trace_id is not null) h from ft) f join nb using (tid) where success = 0 group by 1",
    "repair_length_ratio": _T + "select bench benchmark, count(*) n, round(avg(x), 4) mean_ratio, round(median(x), 4) median_ratio from (select bench, coalesce((7 + length(coalesce(text, ''))) * 1.0 / nullif(length(text), 0), 0.0)::double x from b) group by 1",
}

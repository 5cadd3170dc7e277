"""Scalar functions on text, JSON and labels, as column expressions (no Python UDF but for nested HTML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failscope.operators.windows import last_wins
from failscope.session import table, trim_all

#: The actions, longest name first as texts are searched for them.
ACTIONS = ["RETRIEVE_MORE", "LOCAL_REPAIR", "TOOL_FIX", "ESCALATE", "REPLAN", "RETRY"]
#: Slips of labels that are put right wherever they stand, in this order.
LABEL_SLIPS = {"ESCELATE": "ESCALATE", "REPPLAN": "REPLAN", "REPAN": "REPLAN"}
#: Spellings of domains in lower case.
DOMAIN_NAMES = {
    "gsm8k": "GSM8K",
    "mbpp": "MBPP",
    "sealqa": "SealQA",
    "sealqa hard": "SealQA",
    "medbrowse": "MedBrowseComp",
    "medbrowsecomp": "MedBrowseComp",
    "browsecomp": "BrowseComp",
    "humaneval": "Humaneval",
}


#: Fixed value: what stands behind a shortened part of a rendering.
CUT = "\n...[truncated]"


def truncate(col, n: int, marker: str = "... [truncated]"):
    """Stripped text of at most n characters, and the marker where it was longer."""
    s = trim_all(col)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit(marker))).otherwise(s)


def head_tail(col, n: int, share: float = 0.5, marker: str = "\n...\n"):
    """The first and the last part of a text longer than n characters."""
    head = int(n * share)
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(head)), F.lit(marker), F.right(col, F.lit(n - head)))).otherwise(col)


def clean_lines(col):
    return trim_all(F.regexp_replace(col, "\r\n?", "\n"))


def benchmark_of(experiment):
    """The experiment's name; names that start with ablation_ lose the two known prefixes wherever they stand. Null for an empty name."""
    plain = F.replace(F.replace(experiment, F.lit("ablation_minimality_"), F.lit("")), F.lit("ablation_nogold_"), F.lit(""))
    return F.when(F.length(experiment) > 0, F.when(experiment.startswith("ablation_"), plain).otherwise(experiment))


def domain_of(col):
    """The domain that a benchmark's name stands for; unknown names pass through, an empty one gives null."""
    names = F.create_map(*[F.lit(x) for kv in DOMAIN_NAMES.items() for x in kv])
    return F.when(F.length(col) > 0, F.coalesce(F.element_at(names, F.lower(col)), col))


def ablation_of(experiment):
    """minimality, nogold, or the second part of another ablation's name; null for what is no ablation."""
    known = F.when(experiment.startswith("ablation_minimality_"), "minimality").when(experiment.startswith("ablation_nogold_"), "nogold")
    return known.when(experiment.startswith("ablation_"), F.try_element_at(F.split(experiment, "_", 3), F.lit(2)))


def normal_label(col):
    """Upper case, known slips put right, first of a slash list, and null for what is no action."""
    up = F.upper(col)
    for slip, label in LABEL_SLIPS.items():
        up = F.replace(up, F.lit(slip), F.lit(label))
    first = trim_all(F.split_part(up, F.lit("/"), F.lit(1)))
    return F.when(first.isin(ACTIONS), first)


def parse_action(col):
    """The first action, longest name first, that a reply names; UNKNOWN without one."""
    up = F.upper(col)
    out = F.when(F.lit(False), F.lit(""))
    for a in ACTIONS:
        out = out.when(up.contains(a), a)
    return out.otherwise("UNKNOWN")


def unfenced(col):
    """Text without a Markdown code fence around it."""
    return trim_all(F.regexp_replace(trim_all(col), r"^```\w*\s*\n?|\n?```$", ""))


def parse_prediction(col):
    """struct(action, confidence) of a reply that holds JSON, fenced or not; confidence is clamped to 0..1."""
    v = F.from_json(unfenced(col), "action string, confidence double")
    return F.struct(normal_label(v["action"]).alias("action"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["confidence"])).alias("confidence"))


def safe_name(col):
    return F.regexp_replace(col, r"[^A-Za-z0-9_.-]+", "_")


def normal_text(col):
    """Lower case without ASCII punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"\p{Punct}", ""), r"\s+", " "))


def last_number(col):
    """The last number of a text as a double, thousands marks taken out; null without one."""
    found = F.regexp_extract_all(col, F.lit(r"(-?\d[\d,]*\.?\d*)"), 1)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(",")).try_cast("double")


def token_overlap(gold, answer):
    """Share of the distinct words of `gold` that `answer` has; null for an empty gold."""
    g, a = F.split(normal_text(gold), " "), F.split(normal_text(answer), " ")
    return F.try_divide(F.size(F.array_intersect(g, a)).cast("double"), F.size(F.array_distinct(g)).cast("double"))


def verify_answer(domain, gold, answer):
    """Does the answer hold the gold answer? Numbers must be equal for GSM8K; code may be a short substring or share
    70 per cent of its words; other text must contain it or share 80 per cent. Empty sides are false."""
    g, a = normal_text(gold), normal_text(answer)
    short = F.length(g) <= 30
    code = F.when(short, F.contains(a, g)).otherwise(token_overlap(gold, answer) >= 0.7)
    text = F.contains(a, g) | (token_overlap(gold, answer) >= 0.8)
    number = F.coalesce(last_number(gold) == last_number(answer), F.lit(False))
    ok = F.when(domain == "GSM8K", number).when(domain.isin("MBPP", "Humaneval"), code).otherwise(text)
    return F.coalesce((F.length(trim_all(gold)) > 0) & (F.length(trim_all(answer)) > 0) & ok, F.lit(False))


def code_block(col):
    """What stands in the first code fence, else the stripped text."""
    fence = r"(?s)```(?:python)?\n(.*?)```"
    return trim_all(F.when(col.rlike(fence), F.regexp_extract(col, fence, 1)).otherwise(col))


def entry_point(col):
    """The function that the first assertion of a test calls; null without one."""
    return F.nullif(F.regexp_extract(col, r"assert\s+(\w+)\s*\(", 1), F.lit(""))


def class_definitions(code, tests):
    """The class definitions of a code that its tests name, blank-line separated; empty where either side is missing."""
    blocks = F.regexp_extract_all(code, F.lit(r"(?s)(class \w+.*?)(?=\nclass |\ndef [a-z]|\z)"), 1)
    named = F.filter(blocks, lambda b: F.contains(tests, F.regexp_extract(b, r"class (\w+)", 1)))
    return F.coalesce(F.array_join(F.transform(named, trim_all), "\n\n"), F.lit(""))


def query_list(problem, prior, n: int = 5, longest: int = 200):
    """At most n search queries: the beginning of the problem on one line, then the earlier queries that differ from it."""
    first = F.replace(truncate(F.coalesce(problem, F.lit("")), longest, CUT), F.lit("\n"), F.lit(" "))
    return F.slice(F.concat(F.array(first), F.filter(F.coalesce(prior, F.array().cast("array<string>")), lambda q: q != first)), 1, n)


def problem_number(col):
    """The number after the last hyphen of an id; null where none stands there."""
    return F.try_element_at(F.split(col, "-"), F.lit(-1)).try_cast("int")


def exact_match(a, b):
    """1 or 0 for stripped texts, null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), (trim_all(a) == trim_all(b)).cast("int"))


def first_truthy(*cols):
    """The first value that is neither null, zero nor empty."""
    return F.coalesce(*[F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0"), c) for c in cols])


def message_text(col):
    """Text of a message that is a string, or a JSON list of parts with text."""
    parts = F.from_json(col, "array<struct<text:string>>")
    return F.when(trim_all(col).startswith("["), F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")).otherwise(col)


def prior_queries(steps: DataFrame) -> DataFrame:
    """(trace_id, queries): distinct search queries of each trace, in the order of the steps."""
    j = lambda k: F.nullif(trim_all(F.get_json_object("tool_args_json", f"$.{k}")), F.lit(""))
    q = steps.filter("step_type = 'tool_call' and tool_name = 'web_search'").select("trace_id", "step_index", "step_uid", F.coalesce(j("query"), j("q"), j("input")).alias("q")).filter("q is not null")
    listed = q.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step_uid", "q"))).alias("a"))
    return listed.select("trace_id", F.array_distinct(F.transform("a", lambda x: x["q"])).alias("queries"))


def tool_errors(steps: DataFrame) -> DataFrame:
    """(trace_id, report): failed tool steps as text, or a note that there are none."""
    line = F.concat_ws("\n", F.concat(F.lit("Step "), F.col("step_index").cast("string"), F.lit(" tool "), F.coalesce("tool_name", F.lit("?"))), F.left(F.coalesce("tool_output_json", F.lit("")), F.lit(200)))
    a = F.array_sort(F.collect_list(F.when(F.col("tool_call_result") == 0, F.struct("step_index", "step_uid", line.alias("line")))))
    return steps.groupBy("trace_id").agg(a.alias("a")).select("trace_id", F.when(F.size("a") == 0, "no failed tool calls").otherwise(F.array_join(F.transform("a", lambda x: x["line"]), "\n\n")).alias("report"))


def _when_text(col, value):
    return F.when(F.length(col) > 0, value)


def rendered(max_steps: int = 30, max_text: int = 900, max_args: int = 400):
    """The first steps of an ordered array `a` as text for labelling prompts, and how many were left out (a display feature of the rendering)."""
    def lines(x):
        shown = lambda c: F.coalesce(x[c].cast("string"), F.lit("None"))
        tool = F.coalesce(_when_text(x["tool_name"], F.concat(F.lit(" | tool="), x["tool_name"])), F.lit(""))
        header = F.concat(F.lit("Step "), shown("step_index"), F.lit(" | id="), shown("step_id"), F.lit(" | type="), shown("step_type"), tool)
        part = lambda name, c, n: _when_text(x[c], F.concat(F.lit(f"{name}: "), truncate(x[c], n, CUT)))
        return F.concat_ws("\n", header, part("Tool args", "tool_args_json", max_args), part("Text", "text", max_text), part("Tool output", "tool_output_json", max_text), F.lit(""))

    more = F.size("a") - max_steps
    return F.concat_ws("\n", F.transform(F.slice("a", 1, max_steps), lines), F.when(more > 0, F.concat(F.lit("...["), more.cast("string"), F.lit(" additional steps omitted]"))))


def compact_steps(max_steps: int = 20, max_args: int = 300, max_text: int = 600):
    """The first steps of an ordered array `a` with tool arguments and outputs, for prompts of recovery, and how many were left out."""
    def lines(x):
        header = F.concat(F.lit("Step "), F.coalesce(x["step_index"].cast("string"), F.lit("None")), F.lit(" | type="), F.coalesce(x["step_type"], F.lit("None")), F.coalesce(_when_text(x["tool_name"], F.concat(F.lit(" | tool="), x["tool_name"])), F.lit("")))
        part = lambda name, c, n: _when_text(x[c], F.concat(F.lit(f"  {name}: "), truncate(x[c], n, CUT)))
        return F.concat_ws("\n", header, part("args", "tool_args_json", max_args), part("text", "text", max_text), part("output", "tool_output_json", max_text))

    more = F.size("a") - max_steps
    return F.concat_ws("\n", F.transform(F.slice("a", 1, max_steps), lines), F.when(more > 0, F.concat(F.lit("...["), more.cast("string"), F.lit(" more steps omitted]"))))


def markdown_steps(max_text: int = 900, max_args: int = 500):
    """All steps of an ordered array `a` as Markdown sections."""
    def cut(c, n):
        t = clean_lines(c)
        return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit(CUT))).otherwise(t)

    def section(x):
        shown = lambda c: F.coalesce(x[c].cast("string"), F.lit("None"))
        return F.concat_ws(
            "\n", F.concat(F.lit("### Step "), shown("step_index"), F.lit(" | step_id="), shown("step_id"), F.lit(" | type="), shown("step_type")),
            _when_text(x["tool_name"], F.concat(F.lit("- Tool: `"), x["tool_name"], F.lit("`"))), _when_text(x["tool_args_json"], F.concat(F.lit("- Tool args: `"), cut(x["tool_args_json"], max_args), F.lit("`"))),
            _when_text(x["text"], F.concat(F.lit("\n"), cut(x["text"], max_text))), _when_text(x["tool_output_json"], F.concat(F.lit("\nTool output:\n```text\n"), cut(x["tool_output_json"], max_text), F.lit("\n```"))),
        )

    return F.array_join(F.transform("a", section), "\n")


def _tagged(**values):
    """Lines `[NAME] value`; a null prints as None."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"[{k.upper()}] "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for k, c in values.items()])


def step_lines(x, max_text: int = 600, max_output: int = 400):
    """A step as text lines, with its tool and the beginnings of text and output."""
    tool = F.coalesce(_when_text(x["tool_name"], F.concat(F.lit(" tool="), x["tool_name"])), F.lit(""))
    header = F.concat(F.lit("[STEP "), F.coalesce(x["step_index"].cast("string"), F.lit("None")), F.lit("] type="), F.coalesce(x["step_type"], F.lit("None")), tool)
    text = _when_text(x["text"], F.concat(F.lit("  "), F.left(x["text"], F.lit(max_text))))
    output = _when_text(x["tool_output_json"], F.concat(F.lit("  output: "), F.left(x["tool_output_json"], F.lit(max_output))))
    return F.concat_ws("\n", header, text, output)


#: Tools and step types that have a feature of their own.
TOOLS = ["web_search", "web_fetch", "calculator", "docker_code_execution", "llm_code_generation", "docker_code_execution_result"]
STEP_TYPES = ["reasoning", "tool_call", "tool_response", "final_answer", "llm_response"]


def trace_features() -> dict:
    """Feature name -> double column, over an ordered array `a` of steps and the columns of a trace."""
    n = lambda when: F.size(F.filter("a", when)).cast("double")
    tool = lambda x: (F.coalesce(x["has_tool"], F.lit(0)) != 0) | (F.length(F.coalesce(x["tool_name"], F.lit(""))) > 0)
    failed = lambda x: F.coalesce(x["tool_call_result"] == 0, F.lit(False))
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("double")
    out = {
        "num_steps": F.size("a").cast("double"), "num_tool_calls": n(tool), "num_tool_failures": n(failed), "tool_failure_rate": F.coalesce(F.try_divide(n(failed), n(tool)), F.lit(0.0)),
        "problem_length": length("problem_statement"), "final_answer_length": length("final_answer"),
    }
    is_ = lambda c, t: lambda x: F.coalesce(x[c] == t, F.lit(False))
    out |= {f"steptype_{t}": n(is_("step_type", t)) for t in STEP_TYPES}
    return out | {f"tool_{t}": F.exists("a", is_("tool_name", t)).cast("double") for t in TOOLS}


def with_steps(traces: DataFrame, steps: DataFrame, columns: tuple[str, ...] = ("step_id", "step_type", "text", "tool_name", "tool_args_json", "tool_output_json", "tool_call_result", "has_tool")) -> DataFrame:
    """`traces` with `a`, the steps of each in order (one trace's steps are the unit of every rendering); traces without steps have none."""
    s = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step_uid", *columns))).alias("a"))
    return traces.join(s, "trace_id", "left").withColumn("a", F.coalesce("a", F.array().cast(s.schema["a"].dataType)))


def full_trace():
    """Domain, problem, all steps of an ordered array `a`, and the final answer of a trace as text."""
    return F.concat_ws("\n", _tagged(domain="domain", problem="problem_statement"), F.transform("a", lambda x: step_lines(x)), _tagged(final_answer="final_answer"))


def _printed_double(c):
    """A double as Python prints it: whole numbers with one zero behind the point."""
    return F.when(c == F.floor(c), F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def text_views(traces: DataFrame, steps: DataFrame, consensus: DataFrame) -> DataFrame:
    """(trace_id, full_trace, final_answer_only, verifier_feedback_only, trace_stats_only, causal_neighborhood): the inputs of the classifiers.

    consensus has (trace_id, step_id, consensus_score, is_repairable_step, has_successful_repair, final_critic_summary) of suspicious steps.
    """
    keep = traces.select("trace_id", "domain", "problem_id", "problem_statement", "gold_answer", "final_answer", "answer_exact_match", "num_steps")
    c = consensus.filter("step_id is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "consensus_score", "is_repairable_step", "has_successful_repair", "final_critic_summary"))).alias("sus"))
    j = with_steps(keep, steps).join(c, "trace_id", "left")
    none = F.lit("None")

    def near(x):
        own = F.try_element_at(F.filter("sus", lambda y: y["step_id"] == x["step_id"]), F.lit(-1))
        shown = lambda k: F.coalesce(own[k].cast("string"), none)
        mark = F.when(own.isNotNull(), F.concat(F.lit("[SUSPICIOUS_STEP] score="), shown("consensus_score"), F.lit(" repairable="), shown("is_repairable_step"), F.lit(" successful_repair="), shown("has_successful_repair")))
        summary = _when_text(own["final_critic_summary"], F.concat(F.lit("[CRITIC_SUMMARY] "), F.left(own["final_critic_summary"], F.lit(800))))
        return F.concat_ws("\n", mark, summary, step_lines(x))

    own_steps = F.filter("a", lambda x: F.exists("sus", lambda y: F.abs(y["step_id"] - x["step_id"]) <= 2))
    head = _tagged(domain="domain", problem="problem_statement")
    around = F.when(F.col("sus").isNull(), F.concat_ws("\n", head, _tagged(final_answer="final_answer"), F.lit("[CAUSAL_NEIGHBORHOOD] unavailable"))).otherwise(
        F.concat_ws("\n", head, _tagged(final_answer="final_answer"), F.transform(F.coalesce(own_steps, F.slice("a", 1, 0)), near))
    )
    features = trace_features()
    stats = F.concat_ws("\n", _tagged(domain="domain", num_steps="num_steps"), *[F.concat(F.lit(f"[{k.upper()}] "), _printed_double(features[k])) for k in sorted(features)])
    feedback = _tagged(domain="domain", problem_id="problem_id", gold_answer="gold_answer", agent_final_answer="final_answer", answer_exact_match="answer_exact_match")
    return j.select("trace_id", full_trace().alias("full_trace"), _tagged(final_answer="final_answer").alias("final_answer_only"), feedback.alias("verifier_feedback_only"), stats.alias("trace_stats_only"), around.alias("causal_neighborhood"))


@F.pandas_udf(T.StringType())
def html_text(pages):
    """Visible text of HTML pages; what stands inside script, style and the like is left out, however deep (Arrow batches: a
    regular expression can't follow nesting)."""
    from html.parser import HTMLParser

    import pandas as pd

    hidden = {"script", "style", "noscript", "head", "svg", "template", "iframe"}

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.depth, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag in hidden

        def handle_endtag(self, tag):
            self.depth -= tag in hidden and self.depth > 0

        def handle_data(self, data):
            if not self.depth and data.strip():
                self.out.append(" ".join(data.split()))

    def read(page):
        if page is None:
            return None
        r = Reader()
        r.feed(page)
        r.close()
        return " ".join(r.out)

    return pd.Series([read(p) for p in pages])


# queries


def _one(spark, d, name, key):
    return last_wins(table(spark, d, name), [key], ["ingested_at"])


def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = _one(spark, d, "traces", "trace_id")
    return t.select(
        "trace_id", truncate(F.col("problem_statement"), 60).alias("short"), head_tail(F.col("problem_statement"), 80).alias("ends"), domain_of(F.regexp_replace(F.lower("domain"), "comp$", "")).alias("domain_name"),
        normal_text(F.col("final_answer")).alias("normal"), last_number(F.col("final_answer")).alias("number"), safe_name(F.col("problem_id")).alias("safe"), problem_number(F.col("problem_id")).alias("number_of"),
        exact_match(F.col("gold_answer"), F.col("final_answer")).alias("exact"), code_block(F.col("final_answer")).alias("code"), F.length(clean_lines(F.col("final_answer"))).alias("n_clean"),
        F.sha2("trace_id", 256).alias("sha"), F.get_json_object(F.lit('{"a": [1, {"b": "x"}]}'), "$.a[1].b").alias("json"),
    )


def answer_checks(spark, d):
    t = _one(spark, d, "traces", "trace_id")
    return t.withColumn("ok", verify_answer(F.col("domain"), F.col("gold_answer"), F.col("final_answer"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("n_ok"))


def label_normalisation(spark, d):
    a = table(spark, d, "human_vs_llm_audit")
    return a.select("trace_num", normal_label(F.col("P1")).alias("p1"), normal_label(F.col("P5")).alias("p5"), parse_action(F.coalesce("P1", F.lit(""))).alias("named")).distinct()


def experiment_names(spark, d):
    r = _one(spark, d, "runs", "run_id")
    return r.select("run_id", benchmark_of(F.col("experiment_name")).alias("benchmark_name"), ablation_of(F.col("experiment_name")).alias("ablation_name"), first_truthy(F.col("stats_fixed"), F.col("stats_total")).alias("first_set"))


def query_lists(spark, d):
    """The query list of each trace: its problem, then its own earlier queries."""
    prior = prior_queries(_one(spark, d, "steps", "step_uid"))
    t = _one(spark, d, "traces", "trace_id").filter("problem_statement is not null").select("trace_id", "problem_statement").join(prior, "trace_id", "left")
    return t.select("trace_id", F.array_join(query_list(F.col("problem_statement"), F.col("queries")), "|").alias("queries"))


def search_queries(spark, d):
    return prior_queries(_one(spark, d, "steps", "step_uid")).select("trace_id", F.array_join("queries", "|").alias("queries"), F.size("queries").alias("n"))


def tool_error_reports(spark, d):
    return tool_errors(_one(spark, d, "steps", "step_uid"))


def stored_views(spark, d) -> DataFrame:
    """The views of the stored traces; steps whose tool call failed stand for consensus steps, which no table holds."""
    steps = _one(spark, d, "steps", "step_uid")
    failed = steps.filter("tool_call_result = 0").select("trace_id", "step_id", F.lit(1.0).alias("consensus_score"), F.lit(1).alias("is_repairable_step"), F.lit(0).alias("has_successful_repair"), F.lit(None).cast("string").alias("final_critic_summary"))
    return text_views(_one(spark, d, "traces", "trace_id"), steps, failed)


def trace_text_views(spark, d):
    return stored_views(spark, d)


def step_renderings(spark, d):
    """The renderings of labelling and recovery prompts and of reports."""
    j = with_steps(_one(spark, d, "traces", "trace_id").select("trace_id"), _one(spark, d, "steps", "step_uid"))
    return j.select("trace_id", rendered().alias("label_steps"), compact_steps().alias("compact"), markdown_steps().alias("markdown"))


def visible_text(spark, d):
    """Visible text of the documents that hold a page's markup."""
    docs = table(spark, d, "documents").filter(F.col("text").rlike(r"(?i)<html[\s>]"))
    return docs.select("doc_id", html_text(F.col("text")).alias("visible"))


QUERIES = {f.__name__: f for f in (text_scalars, answer_checks, label_normalisation, experiment_names, search_queries, query_lists, tool_error_reports, trace_text_views, step_renderings, visible_text)}

_T = "with t as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from traces) where rn_ = 1), s as (select * from (select *, row_number() over (partition by step_uid order by ingested_at desc nulls last) rn_ from steps) where rn_ = 1), r as (select * from (select *, row_number() over (partition by run_id order by ingested_at desc nulls last) rn_ from runs) where rn_ = 1)"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"
_NUM = r"try_cast(replace(list_extract(regexp_extract_all({0}, '(-?\d[\d,]*\.?\d*)', 1), -1), ',', '') as double)"
_OVER = f"len(list_intersect(list_distinct(string_split({_NORM.format('gold_answer')}, ' ')), list_distinct(string_split({_NORM.format('final_answer')}, ' ')))) * 1.0 / len(list_distinct(string_split({_NORM.format('gold_answer')}, ' ')))"
_LABEL = lambda c: f"case when x_{c} in ({', '.join(repr(a) for a in ACTIONS)}) then x_{c} end"
# the oracle's own constants, written apart from those of the functions
_SLIP = lambda c: f"regexp_replace(split_part(replace(replace(replace(upper({c}), 'ESCELATE', 'ESCALATE'), 'REPPLAN', 'REPLAN'), 'REPAN', 'REPLAN'), '/', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_DOMAIN = "case lower({0}) when 'gsm8k' then 'GSM8K' when 'mbpp' then 'MBPP' when 'sealqa' then 'SealQA' when 'sealqa hard' then 'SealQA' when 'medbrowse' then 'MedBrowseComp' when 'medbrowsecomp' then 'MedBrowseComp' when 'browsecomp' then 'BrowseComp' when 'humaneval' then 'Humaneval' else nullif({0}, '') end"
_TRUNC = lambda c, n: f"case when length({_STRIP.format(c)}) > {n} then left({_STRIP.format(c)}, {n}) || chr(10) || '...[truncated]' else {_STRIP.format(c)} end"
_part = lambda name, c, n: f"case when {c} <> '' then '{name}' || {_TRUNC(c, n)} end"
_clean = lambda c, n: _TRUNC(f"regexp_replace({c}, chr(13) || chr(10) || '?', chr(10), 'g')", n)
_LINES = "concat_ws(chr(10), '[STEP ' || coalesce(step_index::varchar, 'None') || '] type=' || coalesce(step_type, 'None') || case when tool_name <> '' then ' tool=' || tool_name else '' end, case when text <> '' then '  ' || left(text, 600) end, case when tool_output_json <> '' then '  output: ' || left(tool_output_json, 400) end)"
_VIEWS = _T + f""", o as (select *, {_LINES} line, row_number() over (partition by trace_id order by step_index nulls first, step_uid) pos, coalesce(has_tool, 0) <> 0 or coalesce(tool_name, '') <> '' tool from s),
  bad as (select trace_id, list(step_id) ids from s where tool_call_result = 0 and step_id is not null group by 1),
  k as (select o.*, list_contains(ids, step_id) sus from o join bad using (trace_id) where len(list_filter(ids, lambda x: abs(x - step_id) <= 2)) > 0),
  nr as (select trace_id, string_agg(case when sus then '[SUSPICIOUS_STEP] score=1.0 repairable=1 successful_repair=0' || chr(10) else '' end || line, chr(10) order by pos) near from k group by 1),
  g as (select trace_id, string_agg(line, chr(10) order by pos) lines, count(*) n, count(*) filter (where tool) tools, count(*) filter (where tool_call_result = 0) bad, {', '.join(f"count(*) filter (where step_type = '{t}') t{i}" for i, t in enumerate(('reasoning', 'tool_call', 'tool_response', 'final_answer', 'llm_response'), 1))},
    {', '.join(f"max(cast(coalesce(tool_name = '{t}', false) as int)) u{i}" for i, t in enumerate(('web_search', 'web_fetch', 'calculator', 'docker_code_execution', 'llm_code_generation', 'docker_code_execution_result'), 1))} from o group by 1),
  v as (select t.*, chr(10) e, coalesce(domain, 'None') d, coalesce(problem_statement, 'None') p, coalesce(final_answer, 'None') f, lines, near, b.ids is not null has_bad, {', '.join(f'coalesce({c}, 0) {c}' for c in ('n', 'tools', 'bad', 't1', 't2', 't3', 't4', 't5', 'u1', 'u2', 'u3', 'u4', 'u5', 'u6'))} from t left join g using (trace_id) left join nr using (trace_id) left join bad b using (trace_id))
"""
SQL = {
    "text_scalars": _T + f"""select trace_id, case when length({_STRIP.format('problem_statement')}) > 60 then left({_STRIP.format('problem_statement')}, 60) || '... [truncated]' else {_STRIP.format('problem_statement')} end short,
      case when length(problem_statement) > 80 then left(problem_statement, 40) || chr(10) || '...' || chr(10) || right(problem_statement, 40) else problem_statement end ends, {_DOMAIN.format("regexp_replace(lower(domain), 'comp$', '')")} domain_name,
      {_NORM.format('final_answer')} normal, {_NUM.format('final_answer')} "number", regexp_replace(problem_id, '[^A-Za-z0-9_.-]+', '_', 'g') safe,
      try_cast(list_extract(string_split(problem_id, '-'), -1) as int) number_of, cast({_STRIP.format('gold_answer')} = {_STRIP.format('final_answer')} as int) exact,
      {_STRIP.format("case when regexp_matches(final_answer, '(?s)```(?:python)?\\n(.*?)```') then regexp_extract(final_answer, '(?s)```(?:python)?\\n(.*?)```', 1) else final_answer end")} code,
      length({_STRIP.format("regexp_replace(final_answer, chr(13) || chr(10) || '?', chr(10), 'g')")}) n_clean, sha256(trace_id) sha, 'x' as json from t""",
    "answer_checks": _T + f"""select domain, count(*) n, sum(cast(coalesce(length({_STRIP.format('gold_answer')}) > 0 and length({_STRIP.format('final_answer')}) > 0 and
      case when domain = 'GSM8K' then coalesce({_NUM.format('gold_answer')} = {_NUM.format('final_answer')}, false)
        when domain in ('MBPP', 'Humaneval') then case when length({_NORM.format('gold_answer')}) <= 30 then contains({_NORM.format('final_answer')}, {_NORM.format('gold_answer')}) else {_OVER} >= 0.7 end
        else contains({_NORM.format('final_answer')}, {_NORM.format('gold_answer')}) or {_OVER} >= 0.8 end, false) as int)) n_ok from t group by 1""",
    "label_normalisation": f"select distinct trace_num, {_LABEL('p1')} p1, {_LABEL('p5')} p5, case " + " ".join(f"when contains(upper(coalesce(P1, '')), '{a}') then '{a}'" for a in ACTIONS) + f" else 'UNKNOWN' end named from (select *, {_SLIP('P1')} x_p1, {_SLIP('P5')} x_p5 from human_vs_llm_audit)",
    "experiment_names": _T + "select run_id, case when starts_with(experiment_name, 'ablation_') then replace(replace(experiment_name, 'ablation_minimality_', ''), 'ablation_nogold_', '') else nullif(experiment_name, '') end benchmark_name, case when starts_with(experiment_name, 'ablation_minimality_') then 'minimality' when starts_with(experiment_name, 'ablation_nogold_') then 'nogold' when starts_with(experiment_name, 'ablation_') then split_part(experiment_name, '_', 2) end ablation_name, coalesce(nullif(stats_fixed, 0), nullif(stats_total, 0)) first_set from r",
    "search_queries": _T + f""", q as (select trace_id, step_index, step_uid, coalesce({', '.join("nullif(" + _STRIP.format(f"json_extract_string(try_cast(tool_args_json as json), '$.{k}')") + ", '')" for k in ('query', 'q', 'input'))}) q from s where step_type = 'tool_call' and tool_name = 'web_search'),
      f as (select trace_id, q, min((coalesce(step_index, -1), step_uid)) o from q where q is not null group by 1, 2) select trace_id, string_agg(q, '|' order by o) queries, count(*) n from f group by 1""",
    "query_lists": _T + f""", q as (select trace_id, step_index, step_uid, coalesce({', '.join("nullif(" + _STRIP.format(f"json_extract_string(try_cast(tool_args_json as json), '$.{k}')") + ", '')" for k in ('query', 'q', 'input'))}) q from s where step_type = 'tool_call' and tool_name = 'web_search'),
      f as (select trace_id, q, min((coalesce(step_index, -1), step_uid)) o from q where q is not null group by 1, 2), a as (select trace_id, list(q order by o) qs from f group by 1),
      p as (select trace_id, replace(case when length({_STRIP.format('problem_statement')}) > 200 then left({_STRIP.format('problem_statement')}, 200) || chr(10) || '...[truncated]' else {_STRIP.format('problem_statement')} end, chr(10), ' ') p from t where problem_statement is not null)
      select trace_id, array_to_string(list_slice(list_concat([p], list_filter(coalesce(qs, []), lambda x: x <> p)), 1, 5), '|') queries from p left join a using (trace_id)""",
    "tool_error_reports": _T + """select trace_id, coalesce(string_agg('Step ' || step_index || ' tool ' || coalesce(tool_name, '?') || chr(10) || left(coalesce(tool_output_json, ''), 200), chr(10) || chr(10) order by step_index, step_uid) filter (where tool_call_result = 0), 'no failed tool calls') report from s group by 1""",
    "trace_text_views": _VIEWS + """select trace_id, '[DOMAIN] ' || d || e || '[PROBLEM] ' || p || e || coalesce(lines || e, '') || '[FINAL_ANSWER] ' || f full_trace, '[FINAL_ANSWER] ' || f final_answer_only,
      '[DOMAIN] ' || d || e || '[PROBLEM_ID] ' || coalesce(problem_id, 'None') || e || '[GOLD_ANSWER] ' || coalesce(gold_answer, 'None') || e || '[AGENT_FINAL_ANSWER] ' || f || e || '[ANSWER_EXACT_MATCH] ' || coalesce(answer_exact_match::varchar, 'None') verifier_feedback_only,
      '[DOMAIN] ' || d || e || '[NUM_STEPS] ' || coalesce(num_steps::varchar, 'None') || e || concat_ws(e, '[FINAL_ANSWER_LENGTH] ' || length(coalesce(final_answer, '')) || '.0', '[NUM_STEPS] ' || n || '.0', '[NUM_TOOL_CALLS] ' || tools || '.0', '[NUM_TOOL_FAILURES] ' || bad || '.0', '[PROBLEM_LENGTH] ' || length(coalesce(problem_statement, '')) || '.0',
        '[STEPTYPE_FINAL_ANSWER] ' || t4 || '.0', '[STEPTYPE_LLM_RESPONSE] ' || t5 || '.0', '[STEPTYPE_REASONING] ' || t1 || '.0', '[STEPTYPE_TOOL_CALL] ' || t2 || '.0', '[STEPTYPE_TOOL_RESPONSE] ' || t3 || '.0', '[TOOL_CALCULATOR] ' || u3 || '.0', '[TOOL_DOCKER_CODE_EXECUTION] ' || u4 || '.0', '[TOOL_DOCKER_CODE_EXECUTION_RESULT] ' || u6 || '.0',
        '[TOOL_FAILURE_RATE] ' || case when tools > 0 then (bad / tools)::double else 0.0::double end, '[TOOL_LLM_CODE_GENERATION] ' || u5 || '.0', '[TOOL_WEB_FETCH] ' || u2 || '.0', '[TOOL_WEB_SEARCH] ' || u1 || '.0') trace_stats_only,
      '[DOMAIN] ' || d || e || '[PROBLEM] ' || p || e || '[FINAL_ANSWER] ' || f || case when has_bad then coalesce(e || near, '') else e || '[CAUSAL_NEIGHBORHOOD] unavailable' end causal_neighborhood from v""",
    "step_renderings": _VIEWS + f"""select t.trace_id, coalesce((select string_agg(concat_ws(e, 'Step ' || coalesce(step_index::varchar, 'None') || ' | id=' || coalesce(step_id::varchar, 'None') || ' | type=' || coalesce(step_type, 'None') || case when tool_name <> '' then ' | tool=' || tool_name else '' end,
        {_part('Tool args: ', 'tool_args_json', 400)}, {_part('Text: ', 'text', 900)}, {_part('Tool output: ', 'tool_output_json', 900)}, ''), chr(10) order by step_index nulls first, step_uid) from o where o.trace_id = t.trace_id and pos <= 30) || case when n > 30 then e || '...[' || (n - 30) || ' additional steps omitted]' else '' end, '') label_steps,
      coalesce((select string_agg(concat_ws(e, 'Step ' || coalesce(step_index::varchar, 'None') || ' | type=' || coalesce(step_type, 'None') || case when tool_name <> '' then ' | tool=' || tool_name else '' end,
        {_part('  args: ', 'tool_args_json', 300)}, {_part('  text: ', 'text', 600)}, {_part('  output: ', 'tool_output_json', 600)}), chr(10) order by step_index nulls first, step_uid) from o where o.trace_id = t.trace_id and pos <= 20) || case when n > 20 then e || '...[' || (n - 20) || ' more steps omitted]' else '' end, '') compact,
      coalesce((select string_agg(concat_ws(e, '### Step ' || coalesce(step_index::varchar, 'None') || ' | step_id=' || coalesce(step_id::varchar, 'None') || ' | type=' || coalesce(step_type, 'None'), case when tool_name <> '' then '- Tool: `' || tool_name || '`' end, case when tool_args_json <> '' then '- Tool args: `' || {_clean('tool_args_json', 500)} || '`' end,
        case when text <> '' then e || {_clean('text', 900)} end, case when tool_output_json <> '' then e || 'Tool output:' || e || '```text' || e || {_clean('tool_output_json', 900)} || e || '```' end), chr(10) order by step_index nulls first, step_uid) from o where o.trace_id = t.trace_id), '') markdown from v t""",
    "visible_text": r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style|noscript|head|svg|template|iframe)\b[^>]*>.*?</(script|style|noscript|head|svg|template|iframe)\s*>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) visible from documents where regexp_matches(text, '(?i)<html[\s>]')""",
}

"""Label votes, rater agreement and classification metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.functions.text import ACTIONS, normal_label
from failscope.operators.windows import last_wins
from failscope.session import table

RATERS = ["P1", "P2", "P3", "P4", "P5", "P6"]
LLMS = ["ai_output_p1_openai", "ai_output_p2_openai", "ai_output_p3_llama", "ai_output_p4_llama"]


def votes_long(df: DataFrame, key: str, raters: list[str]) -> DataFrame:
    """(key, pos, rater, label): one row a cell, labels normalised; unrecognised ones are null."""
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("rater"), normal_label(F.col(r)).alias("label")) for i, r in enumerate(raters)])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.pos", "c.rater", "c.label")


def majority(df: DataFrame, key: str, raters: list[str]) -> DataFrame:
    """(key, majority, agreement, n_votes): nulls ignored, ties to the first in rater order; narrow, no shuffle.

    Each label's rank is its count, then the earlier first position; computed inside the row.
    """
    votes = F.filter(F.array(*[normal_label(F.col(r)) for r in raters]), lambda x: x.isNotNull())
    count = lambda a: F.size(F.filter("v", lambda x: x == a))
    best = F.array_max(F.transform(F.array_distinct("v"), lambda a: F.struct(count(a).alias("n"), (-F.array_position(F.col("v"), a)).alias("p"), a.alias("label"))))
    out = df.withColumn("v", votes).withColumn("b", best)
    return out.select(key, F.col("b.label").alias("majority"), F.round(F.try_divide(F.col("b.n").cast("double"), F.size("v").cast("double")), 6).alias("agreement"), F.size("v").alias("n_votes"))


def kappa(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns by group: 1 where chance agreement is full, 0 where no row has both labels; rows with a null side don't count."""
    every = pairs.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("n"))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = every.withColumn("n", F.when(both, F.col("n")).otherwise(0))
    cells = cells.withColumn("t", F.sum("n").over(Window.partitionBy(*group)))  # at most one row a pair of labels
    seen = cells.groupBy(*group).agg(F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"), F.max("t").alias("n"))
    cells = cells.filter("n > 0")
    row = cells.groupBy(*group, F.col(a).alias("label")).agg(F.sum("n").alias("na"), F.max("t").alias("t"))
    col = cells.groupBy(*group, F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = row.join(col, [*group, "label"]).groupBy(*group).agg(F.sum(F.col("na") * F.col("nb") / (F.col("t") * F.col("t"))).alias("pe"))
    pe = F.coalesce("pe", F.lit(0.0))
    po = F.coalesce(F.try_divide(F.col("same").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    k = F.when(F.col("n") == 0, 0.0).when(pe >= 1.0, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    return seen.join(chance, group, "left").select(*group, "n", F.round(po, 6).alias("observed"), F.round(k, 6).alias("kappa"))


def confusion(df: DataFrame, true: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Counts of each (true, predicted) pair of known labels, by group."""
    return df.filter(F.col(true).isin(ACTIONS) & F.col(pred).isin(ACTIONS)).groupBy(*(group or []), true, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, true: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and support by label; zero where a divisor is zero. One pass: each row adds to two labels at most."""
    g = group or []
    hit = F.col(true) == F.col(pred)
    adds = F.when(hit, F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
        F.array(F.struct(F.col(pred).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")), F.struct(F.col(true).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    )
    s = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull()).select(*g, F.explode(adds).alias("x")).groupBy(*g, F.col("x.label").alias("label")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    s = s.withColumn("precision", p).withColumn("recall", r).withColumn("support", F.col("tp") + F.col("fn"))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def evaluate(df: DataFrame, true: str, pred: str, group: list[str]) -> DataFrame:
    """Accuracy, macro and weighted F1 by group, over the union of its true and predicted labels."""
    c = per_class(df, true, pred, group)
    w = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double"))
    return c.groupBy(*group).agg(F.sum("support").alias("n"), F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(w, 4).alias("weighted_f1"))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with count, accuracy and mean confidence, empty bins included, and each bin's share of the calibration error."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = df.filter(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = allb.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the bins
    gap = F.coalesce(F.col("n") / total * F.abs(F.col("acc") - F.col("conf")), F.lit(0.0))
    return out.select("bin", "n", F.round("acc", 6).alias("acc"), F.round("conf", 6).alias("conf"), F.round(gap, 6).alias("gap"))


# queries


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """One row a trace, its earliest."""
    cells = [*RATERS, *LLMS]
    rows = table(spark, d, "human_vs_llm_audit").select("trace_num", "audited_at", *cells)
    return rows.groupBy("trace_num").agg(F.min_by(F.struct(*cells), F.struct("audited_at", *cells)).alias("r")).select("trace_num", "r.*")


def majority_vote(spark, d):
    return majority(_audit(spark, d), "trace_num", RATERS)


def llm_majority(spark, d):
    return majority(_audit(spark, d), "trace_num", LLMS)


def agreement_histogram(spark, d):
    m = majority(_audit(spark, d), "trace_num", RATERS).filter("n_votes > 0")
    a = F.col("agreement")
    bin_ = F.when(a >= 0.999999, "6/6").when(a >= 5 / 6 - 1e-6, "5/6").when(a >= 4 / 6 - 1e-6, "4/6").when(a >= 0.5 - 1e-6, "3/6").otherwise("less")
    names = spark.createDataFrame([(x,) for x in ("6/6", "5/6", "4/6", "3/6", "less")], "bin string")
    return names.join(m.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c")), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def pairwise_kappa(spark, d):
    """Kappa of each pair of raters: pairs come from each row's own cells, without a self-join."""
    a = _audit(spark, d)
    pairs = [F.struct(F.lit(x).alias("rater_a"), F.lit(y).alias("rater_b"), normal_label(F.col(x)).alias("la"), normal_label(F.col(y)).alias("lb")) for i, x in enumerate(RATERS) for y in RATERS[i + 1 :]]
    return kappa(a.select(F.explode(F.array(*pairs)).alias("p")).select("p.*"), ["rater_a", "rater_b"], "la", "lb")


def mean_kappa(spark, d):
    return pairwise_kappa(spark, d).agg(F.round(F.avg("kappa"), 5).alias("mean_kappa"), F.count(F.lit(1)).alias("n_pairs"))


def _judged(spark, d):
    h = majority(_audit(spark, d), "trace_num", RATERS).select("trace_num", F.col("majority").alias("human"))
    return votes_long(_audit(spark, d), "trace_num", LLMS).join(h, "trace_num").filter("human is not null")


def confusion_matrix(spark, d):
    return confusion(_judged(spark, d), "human", "label", ["rater"])


def confusion_wide(spark, d):
    c = confusion(_judged(spark, d), "human", "label").groupBy("human").pivot("label", ACTIONS).agg(F.sum("n"))
    return c.na.fill(0)


def prf_per_class(spark, d):
    c = per_class(_judged(spark, d), "human", "label", ["rater"])
    return c.select("rater", "label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


def evaluate_by_rater(spark, d):
    return evaluate(_judged(spark, d), "human", "label", ["rater"])


def all_differ(spark, d):
    """Traces on which every model's label differs from the humans' majority; a missing label differs."""
    j = votes_long(_audit(spark, d), "trace_num", LLMS).join(majority(_audit(spark, d), "trace_num", RATERS), "trace_num").filter("majority is not null")
    return j.groupBy("trace_num").agg(F.max(F.col("label").eqNullSafe(F.col("majority")).cast("int")).alias("m")).filter("m = 0").select("trace_num")


def label_compare(spark, d):
    """Agreement of two label maps on their common keys."""
    lab = last_wins(table(spark, d, "triage_labels"), ["trace_id"], ["ingested_at"]).select("trace_id", "action_label")
    dev = table(spark, d, "dev").filter("human_majority is not null").groupBy("trace_id").agg(F.min("human_majority").alias("b"))
    j = lab.join(dev, "trace_id").withColumn("same", F.col("action_label").eqNullSafe(F.col("b")).cast("int"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"), F.round(F.try_divide(F.sum("same") * 100.0, F.count(F.lit(1)).cast("double")), 2).alias("pct"), F.min(F.when(F.col("same") == 0, F.col("trace_id"))).alias("first_mismatch"))


def modal_per_domain(spark, d):
    """The most frequent label of each domain; ties to the smaller label."""
    lab = last_wins(table(spark, d, "triage_labels"), ["trace_id"], ["ingested_at"]).filter("domain is not null and action_label is not null")
    c = lab.groupBy("domain", "action_label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("domain").agg(F.min_by(F.struct("action_label", "n"), F.struct(-F.col("n"), "action_label")).alias("m")).select("domain", "m.action_label", "m.n")


def _confidences(spark, d):
    e = table(spark, d, "events").select((F.pmod(F.col("value"), F.lit(1.0))).alias("confidence"), (F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)) == 0).alias("correct"))
    return e


def confidence_bins(spark, d):
    """Calibration of event values as confidences."""
    return calibration(_confidences(spark, d), "confidence", "correct")


def calibration_error(spark, d):
    """The expected calibration error as one number."""
    return calibration(_confidences(spark, d), "confidence", "correct").agg(F.round(F.sum("gap"), 4).alias("ece"), F.sum("n").alias("n"))


def vote_calibration(spark, d):
    """Calibration of the share of humans that agree as the confidence of their majority, against the stored majority: predictions joined to labels by trace."""
    m = majority(_audit(spark, d), "trace_num", RATERS).join(table(spark, d, "human_vs_llm_audit").groupBy("trace_num").agg(F.min("trace_id").alias("trace_id")), "trace_num")
    gold = table(spark, d, "dev").select("trace_id", normal_label(F.col("human_majority")).alias("gold")).filter("gold is not null").groupBy("trace_id").agg(F.min("gold").alias("gold"))
    return calibration(m.join(gold, "trace_id").select("agreement", (F.col("majority") == F.col("gold")).alias("right")), "agreement", "right")


QUERIES = {f.__name__: f for f in (majority_vote, llm_majority, agreement_histogram, pairwise_kappa, mean_kappa, confusion_matrix, confusion_wide, prf_per_class, evaluate_by_rater, all_differ, label_compare, modal_per_domain, confidence_bins, calibration_error, vote_calibration)}


def _norm_sql(c: str) -> str:
    """The oracle's own constants, written apart from those of the functions."""
    s = f"regexp_replace(split_part(replace(replace(replace(upper({c}), 'ESCELATE', 'ESCALATE'), 'REPPLAN', 'REPLAN'), 'REPAN', 'REPLAN'), '/', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    return f"case when {s} in ('RETRY', 'REPLAN', 'RETRIEVE_MORE', 'TOOL_FIX', 'ESCALATE', 'LOCAL_REPAIR') then {s} end"


def _long_sql(cols: list[str]) -> str:
    return " union all ".join(f"select trace_num, {i} pos, '{c}' rater, {_norm_sql(c)} as label from a" for i, c in enumerate(cols))


_A = "with a as (select * from (select *, row_number() over (partition by trace_num order by audited_at nulls first, P1 nulls first, P2 nulls first, P3 nulls first, P4 nulls first, P5 nulls first, P6 nulls first) k_ from human_vs_llm_audit) where k_ = 1), h as (" + _long_sql(RATERS) + "), m as (" + _long_sql(LLMS) + ")"
_MAJ = lambda src: f"select trace_num, label as majority, n, t from (select *, row_number() over (partition by trace_num order by n desc, p) k from (select trace_num, label, count(*) n, min(pos) p, sum(count(*)) over (partition by trace_num) t from {src} where label is not null group by 1, 2)) where k = 1"
_MAJQ = lambda src: _A + f", j as ({_MAJ(src)}) select a.trace_num, majority, round(n * 1.0 / t, 6) agreement, coalesce(t, 0) n_votes from a left join j using (trace_num)"
_J = _A + f", hm as ({_MAJ('h')}), g as (select m.rater, hm.majority human, m.label from m join hm using (trace_num))"
_PAIRS = _A + """, every as (select x.rater rater_a, y.rater rater_b, x.label la, y.label lb from h x join h y on x.trace_num = y.trace_num and x.pos < y.pos), p as (select * from every where la is not null and lb is not null),
 t as (select rater_a, rater_b, count(*) filter (where la is not null and lb is not null) n, coalesce(avg(cast(la = lb as int)), 0) po from every group by 1, 2),
 ra as (select rater_a, rater_b, la as label, count(*) c from p group by 1, 2, 3), rb as (select rater_a, rater_b, lb as label, count(*) c from p group by 1, 2, 3),
 e as (select ra.rater_a, ra.rater_b, sum(ra.c * 1.0 * rb.c) pe from ra join rb using (rater_a, rater_b, label) group by 1, 2),
 k as (select rater_a, rater_b, n, po, coalesce(pe / nullif(n * n, 0), 0) pe from t left join e using (rater_a, rater_b)),
 r as (select rater_a, rater_b, n, round(po, 6) observed, round(case when n = 0 then 0 when pe >= 1 then 1 else (po - pe) / (1 - pe) end, 6) kappa from k)"""
_PC = _J + """, c as (select rater, label, sum(tp) tp, sum(fp) fp, sum(fn) fn from (
  select rater, label, cast(human = label as int) tp, cast(human <> label as int) fp, 0 fn from g where label is not null
  union all select rater, human, 0, 0, 1 from g where label is not null and human <> label) group by 1, 2),
 f as (select *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) "precision", coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) recall, tp + fn support from c),
 z as (select *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) f1 from f)"""
_L = "with l as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from triage_labels) where rn_ = 1)"
_BINS = "with e as (select value - floor(value) c, cast(json_extract_string(props, '$.k') as int) % 2 = 0 ok from events), g as (select cast(least(floor(c * 10), 9) as int) bin, count(*) n, avg(cast(ok as int)) acc, avg(c) conf from e where c is not null group by 1) select cast(b.bin as int) bin, coalesce(n, 0) n, round(acc, 6) acc, round(conf, 6) conf, round(coalesce(n * 1.0 / (select sum(n) from g) * abs(acc - conf), 0), 6) gap from (select range bin from range(10)) b left join g using (bin)"
SQL = {
    "majority_vote": _MAJQ("h"), "llm_majority": _MAJQ("m"),
    "agreement_histogram": _A + f", j as ({_MAJ('h')}), b as (select case when n * 6 >= 6 * t then '6/6' when n * 6 >= 5 * t then '5/6' when n * 6 >= 4 * t then '4/6' when n * 2 >= t then '3/6' else 'less' end bin from j) select x.bin, count(b.bin) n from (select unnest(['6/6', '5/6', '4/6', '3/6', 'less']) bin) x left join b using (bin) group by 1",
    "pairwise_kappa": _PAIRS + "select * from r", "mean_kappa": _PAIRS + "select round(avg(kappa), 5) mean_kappa, count(*) n_pairs from r",
    "confusion_matrix": _J + "select rater, human, label, count(*) n from g where label is not null group by 1, 2, 3",
    "confusion_wide": _J + "select human, " + ", ".join(f"count(*) filter (where label = '{a}') \"{a}\"" for a in ACTIONS) + " from g where label is not null group by 1",
    "prf_per_class": _PC + 'select rater, label, tp, fp, fn, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, support from z',
    "evaluate_by_rater": _PC + "select rater, sum(support) n, round(sum(tp) * 1.0 / nullif(sum(support), 0), 4) accuracy, round(avg(f1), 4) macro_f1, round(sum(f1 * support) / nullif(sum(support), 0), 4) weighted_f1 from z group by 1",
    "all_differ": _A + f", hm as ({_MAJ('h')}) select m.trace_num from m join hm using (trace_num) group by 1 having max(cast(m.label is not distinct from hm.majority as int)) = 0",
    "label_compare": _L + ", d as (select trace_id, min(human_majority) b from dev where human_majority is not null group by 1), j as (select trace_id, cast(action_label is not distinct from b as int) same from l join d using (trace_id)) select count(*) n, sum(same) n_same, round(sum(same) * 100.0 / nullif(count(*), 0), 2) pct, min(case when same = 0 then trace_id end) first_mismatch from j",
    "modal_per_domain": _L + "select domain, action_label, n from (select domain, action_label, count(*) n, row_number() over (partition by domain order by count(*) desc, action_label) k from l where domain is not null and action_label is not null group by 1, 2) where k = 1",
    "confidence_bins": _BINS,
    "calibration_error": f"select round(sum(gap), 4) ece, sum(n) n from ({_BINS})",
    "vote_calibration": _A + f""", j as ({_MAJ('h')}), g as (select trace_id, min(x) gold from (select trace_id, {_norm_sql('human_majority')} x from dev) where x is not null group by 1),
     e as (select round(n * 1.0 / t, 6) c, majority = gold ok from j join (select trace_num, min(trace_id) trace_id from human_vs_llm_audit group by 1) using (trace_num) join g using (trace_id)),
     b as (select cast(least(floor(c * 10), 9) as int) bin, count(*) n, avg(cast(ok as int)) acc, avg(c) conf from e group by 1)
     select cast(x.bin as int) bin, coalesce(n, 0) n, round(acc, 6) acc, round(conf, 6) conf, round(coalesce(n * 1.0 / (select sum(n) from b) * abs(acc - conf), 0), 6) gap from (select range bin from range(10)) x left join b using (bin)""",
}

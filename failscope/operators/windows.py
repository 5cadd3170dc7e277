"""Window semantics: last-wins, ranks, running totals, samples, splits, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.session import checkpointed, table, trim_all


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the greatest order columns; ties go to the row with the greatest hash.

    An aggregation (max_by with map-side combine) in place of a window, so a hot key never has all its rows in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.coalesce(F.unix_micros(c) if t == "timestamp" else F.col(c), F.lit(-(2**62)) if t == "timestamp" else F.col(c)).alias(f"o{i}") for i, (c, t) in enumerate((c, dict(df.dtypes)[c]) for c in order)], F.xxhash64(*[F.col(c) for c in rest]).alias("h"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def ordinals(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers from 1 in a total order, without one task for all rows: a range sort, partition counts, and local row numbers."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    counts = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    starts = counts.select("pid", (F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).alias("start"))
    local = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return placed.withColumn("k", local).join(F.broadcast(starts), "pid").select(*df.columns, (F.coalesce("start", F.lit(0)) + F.col("k")).cast("bigint").alias("ordinal"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group (Catalyst's WindowGroupLimit cuts each partition before the shuffle)."""
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rk") <= n)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df with k (rank in the group, from 1), n (rows of the group) and cum_<c> for each column of `sums`, in a total order.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks; each task
    ranks and sums its own stretch, and the totals of earlier stretches (one row a partition and group) are added.
    Rows with a null group take no part.
    """
    placed = checkpointed(df.repartitionByRange(*group, *order).withColumn("pid_", F.spark_partition_id()))
    part = placed.groupBy(*group, "pid_").agg(F.count(F.lit(1)).alias("c_"), *[F.sum(c).alias(f"s_{c}") for c in sums])
    earlier = Window.partitionBy(*group).orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*group, "pid_", F.coalesce(F.sum("c_").over(earlier), F.lit(0)).alias("o_"), F.sum("c_").over(Window.partitionBy(*group)).alias("n"), *[F.coalesce(F.sum(f"s_{c}").over(earlier), F.lit(0)).alias(f"o_{c}") for c in sums])
    local = Window.partitionBy("pid_", *group).orderBy(*order)
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.select("*", F.row_number().over(local).alias("k_"), *[F.sum(c).over(run).alias(f"r_{c}") for c in sums]).join(offsets, [*group, "pid_"])
    return out.select(*df.columns, (F.col("o_") + F.col("k_")).cast("bigint").alias("k"), "n", *[(F.col(f"o_{c}") + F.col(f"r_{c}")).alias(f"cum_{c}") for c in sums])


def running_curve(df: DataFrame, group: list[str], cost: str, gain: str, tie: str, points: int = 50) -> DataFrame:
    """Running cost and gain of each group in order of cost, thinned to every k-th point and the last."""
    out = prefix_sums(df.select(*group, cost, gain, tie), group, [cost, tie], [cost, gain])
    every = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    thin = out.filter((F.pmod(F.col("k") - 1, every) == 0) | (F.col("k") == F.col("n")))
    return thin.select(*group, "k", "n", F.col(f"cum_{cost}").alias("cum_cost"), F.col(f"cum_{gain}").alias("cum_gain"))


def budget_regime(df: DataFrame, group: list[str], cost: str, gain: str, tie: str, budgets: list[float]) -> DataFrame:
    """For each group and budget: how much gain the cheapest rows within the budget bring (costs are not negative)."""
    cum = prefix_sums(df.select(*group, cost, gain, tie), group, [cost, tie], [cost]).withColumnRenamed(f"cum_{cost}", "cum_cost")
    # each row is explained by the smallest budget that holds it; budgets beyond take it in by a running sum over the few budgets
    grid = F.array(*[F.lit(float(b)) for b in sorted(budgets)])
    first = F.array_min(F.filter(grid, lambda b: b >= F.col("cum_cost")))
    hit = cum.select(*group, first.alias("budget"), gain).filter("budget is not null").groupBy(*group, "budget").agg(F.sum(gain).alias("g"), F.count(F.lit(1)).alias("c"))
    every = df.select(*group).distinct().withColumn("budget", F.explode(grid))
    run_b = Window.partitionBy(*group).orderBy("budget").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.join(hit, [*group, "budget"], "left")
    return out.select(*group, "budget", F.coalesce(F.sum("g").over(run_b), F.lit(0)).alias("gain"), F.coalesce(F.sum("c").over(run_b), F.lit(0)).alias("n_rows"))


def neighbourhood(spark_steps: DataFrame, is_centre, reach: int = 2) -> DataFrame:
    """(trace_id, step_id): steps within ± reach of a centre step, by value of step_id: centres are spread to their neighbours and met by an equi-join."""
    centres = spark_steps.filter(is_centre).select("trace_id", F.explode(F.sequence(F.col("step_id") - reach, F.col("step_id") + reach)).alias("step_id")).distinct()
    return spark_steps.select("trace_id", "step_id").distinct().join(centres, ["trace_id", "step_id"], "left_semi")


def pareto(df: DataFrame, name: str, gain: str, cost: str) -> DataFrame:
    """Rows that no other row beats on both gain (more) and cost (less).

    The best gain of each cost meets the best of all lower costs: a sort by range, the best of each stretch (one row a
    partition), and running bests inside stretches, instead of a theta join or one task for all costs.
    """
    best = df.groupBy(cost).agg(F.max(gain).alias("s"))
    placed = checkpointed(best.repartitionByRange(cost).withColumn("pid_", F.spark_partition_id()))
    earlier = placed.groupBy("pid_").agg(F.max("s").alias("m_")).select("pid_", F.max("m_").over(Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)).alias("e_"))  # one row a partition
    local = F.max("s").over(Window.partitionBy("pid_").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    run = placed.withColumn("l_", local).join(F.broadcast(earlier), "pid_").withColumn("b", F.greatest("l_", "e_"))
    edge = run.filter(F.col("b").isNull() | (F.col("b") < F.col("s"))).select(cost, F.col("s").alias(gain))
    return df.join(edge, [cost, gain]).select(name, cost, gain)


def hash_rank(group: list[str], key: str, seed: int = 42):
    """Rank of a row in its group in a shuffled order that any engine can repeat: md5 of seed and key."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, rare: int = 10, share: float = 0.1) -> DataFrame:
    """Train, dev and test per label: labels with fewer than three rows all train, fewer than `rare` one test and one dev, else a share each."""
    held = F.greatest(F.lit(1), F.bround(F.col("n") * share))
    hashed = df.withColumn("h_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))))
    out = prefix_sums(hashed, [label], ["h_", key], []).withColumnRenamed("k", "rk").drop("h_")
    split = (
        F.when(F.col("n") < 3, "train")
        .when((F.col("n") < rare) & (F.col("rk") == F.col("n")), "test").when((F.col("n") < rare) & (F.col("rk") == F.col("n") - 1), "dev").when(F.col("n") < rare, "train")
        .when(F.col("rk") <= held, "test").when(F.col("rk") <= 2 * held, "dev").otherwise("train")
    )
    return out.withColumn("split", split).drop("n", "rk")


def holdout_split(df: DataFrame, label: str, key: str, seed: int = 42, share: float = 0.2, rare: str = "ESCALATE", into: str = "RETRY") -> DataFrame:
    """Train and test per label, a share of each held out in a seeded order. Where a label has a single row, `rare` counts as `into` for the split."""
    single = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("least"))
    group = F.when((F.col("least") < 2) & (F.col(label) == rare), into).otherwise(F.col(label))
    hashed = df.crossJoin(F.broadcast(single)).withColumn("g_", group).drop("least").withColumn("h_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))))  # one row
    out = prefix_sums(hashed, ["g_"], ["h_", key], [])
    return out.withColumn("split", F.when(F.col("k") <= F.bround(F.col("n") * share), "test").otherwise("train")).drop("g_", "h_", "k", "n")


def resolved_splits(df: DataFrame, label: str, key: str, dev_in_train: bool = False) -> DataFrame:
    """The stored split of each row where rows of all three splits are there, else a fresh holdout split; dev counts as train if wanted."""
    name = F.lower(trim_all(F.col("split")))
    frozen = df.withColumn("split", F.when(name == "validation", "dev").when(name.isin("train", "dev", "test"), name)).filter("split is not null")
    if frozen.agg(F.count_distinct("split")).first()[0] < 3:
        return holdout_split(df.drop("split"), label, key)
    return frozen.withColumn("split", F.when(F.col("split") == "dev", "train").otherwise(F.col("split"))) if dev_in_train else frozen


# queries over the run tables


def _latest_labels(spark, d):
    return last_wins(table(spark, d, "triage_labels").select("trace_id", "domain", "action_label", "split", "ingested_at"), ["trace_id"], ["ingested_at"])


def last_wins_traces(spark: SparkSession, d: str) -> DataFrame:
    return last_wins(table(spark, d, "traces").select("trace_id", "problem_id", "ingested_at"), ["trace_id"], ["ingested_at"]).select("trace_id", F.unix_micros("ingested_at").alias("ingested_us"), "problem_id")


def pilot_per_group(spark, d):
    return top_per_group(_latest_labels(spark, d).filter("domain is not null").select("domain", "trace_id"), ["domain"], ["trace_id"], 10).select("domain", "trace_id", "rk")


def balanced_sample(spark, d):
    """Five rows per label in a seeded order."""
    return _latest_labels(spark, d).filter("action_label is not null").withColumn("rk", hash_rank(["action_label"], "trace_id")).filter("rk <= 5").select("action_label", "trace_id", "rk")


def split_by_label(spark, d):
    return stratified_split(_latest_labels(spark, d).filter("action_label is not null").select("trace_id", "action_label"), "action_label", "trace_id")


def held_out(spark, d):
    return holdout_split(_latest_labels(spark, d).filter("action_label is not null").select("trace_id", "action_label"), "action_label", "trace_id")


def resolved_split_counts(spark, d):
    rows = _latest_labels(spark, d).filter("action_label is not null").select("trace_id", "action_label", "split")
    return resolved_splits(rows, "action_label", "trace_id", dev_in_train=True).groupBy("split", "action_label").agg(F.count(F.lit(1)).alias("n"))


def split_label_counts(spark, d):
    s = split_by_label(spark, d)
    total = Window.partitionBy("split")
    c = s.groupBy("split", "action_label").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(total), 2))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("cost"), (F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)) == 0).cast("int").alias("gain"))


def cost_curve(spark, d):
    c = running_curve(_events(spark, d), ["event_type"], "cost", "gain", "event_id")
    return c.select("event_type", "k", F.round("cum_cost", 4).alias("cum_cost"), F.col("cum_gain").cast("bigint").alias("cum_gain"))


def budget_gains(spark, d):
    b = budget_regime(_events(spark, d), ["event_type"], "cost", "gain", "event_id", [x * 250.0 for x in range(1, 41)])
    return b.select("event_type", "budget", F.col("gain").cast("bigint").alias("gain"), F.col("n_rows").cast("bigint").alias("n_rows"))


def pareto_frontier(spark, d):
    per = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("cost"), F.round(F.avg(F.col("p_size").cast("double")), 4).alias("gain"))
    return pareto(per, "p_brand", "gain", "cost")


def scale_ranks(spark, d):
    """Rank of each group by gain less weighted cost, for several weights; a stable order by name."""
    per = _events(spark, d).groupBy("event_type").agg(F.avg(F.col("gain").cast("double")).alias("g"), F.avg("cost").alias("c"))
    w = per.withColumn("weight", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0, 5.0, 10.0)]))).withColumn("utility", F.round(F.col("g") - F.col("weight") * F.col("c") / 100, 6))
    return w.withColumn("rk", F.row_number().over(Window.partitionBy("weight").orderBy(F.col("utility").desc(), "event_type"))).select("weight", "event_type", "utility", "rk")


def window_neighbourhood(spark, d):
    s = last_wins(table(spark, d, "steps").select("step_uid", "trace_id", "step_id", "tool_call_result", "ingested_at"), ["step_uid"], ["ingested_at"]).filter("step_id is not null")
    return neighbourhood(s, F.col("tool_call_result") == 0).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_near"))


def cheapest_success(spark, d):
    """Cheapest successful row of each key; without any, the first row."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("value").alias("cost"), (F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)) == 0).alias("ok"))
    best = F.min_by(F.struct("event_id", "event_type"), F.struct((~F.col("ok")).cast("int").alias("bad"), F.when(F.col("ok"), F.col("cost")).alias("c"), F.col("event_id").alias("e")))
    return e.groupBy("user_id").agg(best.alias("b"), F.max("ok").alias("any_ok")).select("user_id", "b.event_id", "b.event_type", "any_ok")


QUERIES = {f.__name__: f for f in (last_wins_traces, pilot_per_group, balanced_sample, split_by_label, held_out, resolved_split_counts, split_label_counts, cost_curve, budget_gains, pareto_frontier, scale_ranks, window_neighbourhood, cheapest_success)}

_L = "with l as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from triage_labels) where rn_ = 1)"
_SPLIT = _L + """, x as (select trace_id, action_label, count(*) over (partition by action_label) n, row_number() over (partition by action_label order by md5('42:' || trace_id), trace_id) rk from l where action_label is not null),
y as (select trace_id, action_label, case when n < 3 then 'train' when n < 10 then case when rk = n then 'test' when rk = n - 1 then 'dev' else 'train' end
  when rk <= greatest(1, round_even(n * 0.1, 0)) then 'test' when rk <= 2 * greatest(1, round_even(n * 0.1, 0)) then 'dev' else 'train' end as split from x)"""
_E = "with e as (select event_id, event_type, user_id, value as cost, cast(cast(json_extract_string(props, '$.k') as int) % 2 = 0 as int) gain from events)"
SQL = {
    "last_wins_traces": "select trace_id, epoch_us(ingested_at) ingested_us, problem_id from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from traces) where rn_ = 1",
    "pilot_per_group": _L + "select domain, trace_id, rk from (select domain, trace_id, row_number() over (partition by domain order by trace_id) rk from l where domain is not null) where rk <= 10",
    "balanced_sample": _L + "select action_label, trace_id, rk from (select action_label, trace_id, row_number() over (partition by action_label order by md5('42:' || trace_id), trace_id) rk from l where action_label is not null) where rk <= 5",
    "split_by_label": _SPLIT + "select trace_id, action_label, split from y",
    "held_out": _L + """, x as (select trace_id, action_label, case when (select min(c) from (select count(*) c from l where action_label is not null group by action_label)) < 2 and action_label = 'ESCALATE' then 'RETRY' else action_label end g from l where action_label is not null)
      select trace_id, action_label, case when row_number() over (partition by g order by md5('42:' || trace_id), trace_id) <= round_even(count(*) over (partition by g) * 0.2, 0) then 'test' else 'train' end as split from x""",
    "resolved_split_counts": _L + r""", x as (select action_label, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) s from l where action_label is not null) select case when s in ('train', 'dev', 'validation') then 'train' else s end as split, action_label, count(*) n from x where s in ('train', 'dev', 'validation', 'test') group by 1, 2""",
    "split_label_counts": _SPLIT + "select split, action_label, count(*) n, round(100.0 * count(*) / sum(count(*)) over (partition by split), 2)::double pct from y group by 1, 2",
    "cost_curve": _E + ", c as (select event_type, row_number() over w k, count(*) over (partition by event_type) n, sum(cost) over (w rows unbounded preceding) cum_cost, sum(gain) over (w rows unbounded preceding) cum_gain from e window w as (partition by event_type order by cost, event_id)) select event_type, k, round(cum_cost, 4) cum_cost, cast(cum_gain as bigint) cum_gain from c where (k - 1) % greatest(1, n // 50) = 0 or k = n",
    "budget_gains": _E + ", c as (select event_type, gain, sum(cost) over (partition by event_type order by cost, event_id rows unbounded preceding) cum from e), b as (select range * 250.0::double budget from range(1, 41)), g as (select distinct event_type from e) select g.event_type, b.budget::double budget, cast(coalesce(sum(c.gain), 0) as bigint) gain, count(c.gain) n_rows from g cross join b left join c on c.event_type = g.event_type and c.cum <= b.budget group by 1, 2",
    "pareto_frontier": "with p as (select p_brand, round(avg(p_retailprice), 4) as cost, round(avg(cast(p_size as double)), 4) gain from part group by 1) select p_brand, cost, gain from p a where not exists (select 1 from p b where (b.gain >= a.gain and b.cost < a.cost) or (b.gain > a.gain and b.cost <= a.cost))",
    "scale_ranks": _E + ", p as (select event_type, avg(cast(gain as double)) g, avg(cost) c from e group by 1), u as (select w.weight, event_type, round(g - w.weight * c / 100, 6) utility from p, (select unnest([0.0, 0.5, 1.0, 2.0, 5.0, 10.0])::double weight) w) select weight, event_type, utility, row_number() over (partition by weight order by utility desc, event_type) rk from u",
    "window_neighbourhood": "with s as (select * from (select *, row_number() over (partition by step_uid order by ingested_at desc nulls last) rn_ from steps) where rn_ = 1 and step_id is not null) select trace_id, count(distinct step_id) n_near from s a where exists (select 1 from s c where c.trace_id = a.trace_id and c.tool_call_result = 0 and c.step_id between a.step_id - 2 and a.step_id + 2) group by 1",
    "cheapest_success": _E + "select user_id, event_id, event_type, any_ok from (select *, bool_or(gain = 1) over (partition by user_id) any_ok, row_number() over (partition by user_id order by 1 - gain, case when gain = 1 then cost end nulls first, event_id) k from e) where k = 1",
}

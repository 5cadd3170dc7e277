"""Problem 5: references to records that do not exist.

Every change of a table becomes a signed delta on the key it touches: a row that refers to a parent
adds one to the references of the parent's key, a parent row adds one to its existence, a valid
tombstone takes all existence away. Folding deltas is a sum, so a state can be kept and new changes
folded in (`fold`) by a batch job or by a stream. Keys with references and no existence are the
current orphans; keys whose parent arrived after a referring row are late.

Scale: a fold is one hash aggregation with map-side combine, so a key that holds a third of all
rows shrinks to one partial row a task. Only keys at fault are joined back to the referring rows,
and rows without a key need no join at all; the join is left to AQE, which broadcasts the faulty
keys only after having measured them and otherwise splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import blank_to_null, month_of, require, table

#: referring table -> (own key, reference column, parent table, parent key)
REFERENCES = {
    "traces": ("trace_id", "run_id", "runs", "run_id"),
    "triage_labels": ("trace_id", "trace_id", "traces", "trace_id"),
    "steps": ("step_uid", "trace_id", "traces", "trace_id"),
}

STATE = ("entity", "ref_key", "refs", "existence", "tombstones", "first_seen", "first_ref")


def canonical_key(col):
    """Keys compare without letter case and surrounding white space; an empty key is null."""
    return F.lower(blank_to_null(col))


def reference_rows(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, entity, row_key, ref_key, ingested_at) of every referring row of a table."""
    own, ref, parent, _ = REFERENCES[table_name]
    return df.select(
        F.lit(table_name).alias("table_name"), F.lit(parent).alias("entity"), F.col(own).alias("row_key"),
        canonical_key(F.col(ref)).alias("ref_key"), F.col("ingested_at"),
    )


def _delta(df: DataFrame, refs, existence, tombstones, first_seen, first_ref) -> DataFrame:
    return df.filter(F.col("ref_key").isNotNull()).select(
        "entity", "ref_key", refs.cast("bigint").alias("refs"), existence.cast("bigint").alias("existence"),
        tombstones.cast("bigint").alias("tombstones"), first_seen.cast("timestamp").alias("first_seen"), first_ref.cast("timestamp").alias("first_ref"),
    )


def reference_deltas(rows: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return _delta(rows, F.lit(1), zero, zero, F.lit(None), F.col("ingested_at"))


def parent_deltas(df: DataFrame, entity: str, key: str) -> DataFrame:
    zero = F.lit(0)
    rows = df.select(F.lit(entity).alias("entity"), canonical_key(F.col(key)).alias("ref_key"), "ingested_at")
    return _delta(rows, zero, F.lit(1), zero, F.col("ingested_at"), F.lit(None))


def tombstone_deltas(df: DataFrame, entities: list[str]) -> DataFrame:
    """A notice whose restored_at is set is void and changes nothing."""
    zero = F.lit(0)
    rows = df.filter(F.col("restored_at").isNull() & F.lower(blank_to_null(F.col("entity"))).isin(entities)).select(
        F.lower(blank_to_null(F.col("entity"))).alias("entity"), canonical_key(F.col("record_key")).alias("ref_key")
    )
    return _delta(rows, zero, zero, F.lit(1), F.lit(None), F.lit(None))


def fold(*deltas: DataFrame) -> DataFrame:
    """Sum deltas, or an earlier state and new deltas, to one row a key (see STATE)."""
    out = deltas[0].select(*STATE)
    for d in deltas[1:]:
        out = out.unionByName(d.select(*STATE))
    return out.groupBy("entity", "ref_key").agg(
        F.sum("refs").alias("refs"), F.sum("existence").alias("existence"), F.sum("tombstones").alias("tombstones"),
        F.min("first_seen").alias("first_seen"), F.min("first_ref").alias("first_ref"),
    )


def faulty_keys(state: DataFrame) -> DataFrame:
    """Keys with references and no existence (a valid tombstone ends it), or referred to before they arrived."""
    alive = (F.col("tombstones") == 0) & (F.col("existence") > 0)
    fault = F.when(F.col("tombstones") > 0, "deleted").when(F.col("existence") <= 0, "missing").when(alive & (F.col("first_ref") < F.col("first_seen")), "late")
    return state.filter(F.col("refs") > 0).withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("entity", "ref_key", "fault", "first_seen")


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_key, reason, ingested_at): one row a referring row at fault.

    tables: the referring tables named in REFERENCES (all, or some), their parents and, if there
    are any, tombstones. Defined results: a null or empty reference is `missing`; a row whose
    ingested_at is null is never `late`; repeated rows of one key count once, with their earliest
    ingested_at; empty tables give no rows; other columns are ignored.
    """
    named = [t for t in REFERENCES if t in tables]
    rows = None
    for t in named:
        own, ref, _, _ = REFERENCES[t]
        r = reference_rows(require(tables[t], *dict.fromkeys((own, ref, "ingested_at"))), t)
        rows = r if rows is None else rows.unionByName(r)
    parents = {REFERENCES[t][2]: REFERENCES[t][3] for t in named}
    deltas = [reference_deltas(rows)] + [parent_deltas(require(tables[p], k, "ingested_at"), p, k) for p, k in parents.items()]
    if "tombstones" in tables:
        deltas.append(tombstone_deltas(require(tables["tombstones"], "entity", "record_key", "restored_at"), list(parents)))
    bad = faulty_keys(fold(*deltas))
    keyless = rows.filter(F.col("ref_key").isNull()).select("table_name", "row_key", F.lit("missing").alias("reason"), "ingested_at")
    late = F.col("fault") == "late"
    found = (
        rows.filter(F.col("ref_key").isNotNull()).join(bad, ["entity", "ref_key"])
        .filter(~late | (F.col("ingested_at") < F.col("first_seen")))
        .select("table_name", "row_key", F.col("fault").alias("reason"), "ingested_at")
    )
    return found.unionByName(keyless).groupBy("table_name", "row_key", "reason").agg(F.min("ingested_at").alias("ingested_at"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, month of ingested_at and reason."""
    return found.groupBy("table_name", month_of(F.col("ingested_at")).alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("runs", "traces", "triage_labels", "steps", "tombstones")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_tables(spark, d)).select("table_name", "row_key", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphans(_tables(spark, d)))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_FOUND = f"""
with refs as (
  select 'traces' table_name, 'runs' entity, trace_id row_key, {_KEY.format('run_id')} k, ingested_at from traces
  union all select 'triage_labels', 'traces', trace_id, {_KEY.format('trace_id')}, ingested_at from triage_labels
  union all select 'steps', 'traces', step_uid, {_KEY.format('trace_id')}, ingested_at from steps),
parents as (
  select entity, k, min(ingested_at) first_seen from (
    select 'runs' entity, {_KEY.format('run_id')} k, ingested_at from runs
    union all select 'traces', {_KEY.format('trace_id')}, ingested_at from traces) where k is not null group by 1, 2),
dead as (select distinct {_KEY.format('entity')} entity, {_KEY.format('record_key')} k from tombstones where restored_at is null),
found as (
  select r.table_name, r.row_key, r.ingested_at,
    case when d.k is not null then 'deleted' when p.k is null then 'missing' when r.ingested_at < p.first_seen then 'late' end reason
  from refs r left join parents p on p.entity = r.entity and p.k = r.k left join dead d on d.entity = r.entity and d.k = r.k)
"""
SQL = {
    "p5_found": _FOUND + "select distinct table_name, row_key, reason from found where reason is not null",
    "p5_report": _FOUND + """select table_name, strftime(ingested_at, '%Y-%m') as "month", reason, count(*) n_rows from (
      select table_name, row_key, reason, min(ingested_at) ingested_at from found where reason is not null group by 1, 2, 3) group by 1, 2, 3""",
}

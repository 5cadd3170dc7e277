from datetime import datetime

from failscope.operators import integrity as I

T1, T2, T3 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)


def tables(spark, runs=(), traces=(), labels=(), steps=(), tombs=()):
    extra = "refs bigint, entity_ string"  # columns that clash with the operator's own are ignored
    return {
        "runs": spark.createDataFrame([(*r, 1, "x") for r in runs], f"run_id string, ingested_at timestamp, {extra}"),
        "traces": spark.createDataFrame([(*r, 1, "x") for r in traces], f"trace_id string, run_id string, ingested_at timestamp, {extra}"),
        "triage_labels": spark.createDataFrame([(*r, 1, "x") for r in labels], f"trace_id string, ingested_at timestamp, {extra}"),
        "steps": spark.createDataFrame([(*r, 1, "x") for r in steps], f"step_uid string, trace_id string, ingested_at timestamp, {extra}"),
        "tombstones": spark.createDataFrame(list(tombs), "entity string, record_key string, deleted_at timestamp, restored_at timestamp"),
    }


def found(t):
    return sorted((r.table_name, r.row_key, r.reason) for r in I.orphans(t).collect())


def test_reasons(spark):
    t = tables(
        spark, runs=[("r1", T2), ("r1", T3), ("r2", T1)], traces=[("t1", " R1\t", T3), ("t2", "r2", T3), ("t3", "rx", T3), ("t4", None, T3), ("t5", "  ", T3), ("t6", "r1", T1)],
        labels=[("t1", T3), ("T9", T3)], steps=[("s1", "t1 ", T3), ("s1", "t1 ", T3), ("s2", "t2", T3), ("s3", None, T3), ("s4", "t1", None)],
        tombs=[("runs", "R2", T3, None), ("runs", "r1", T3, T3), ("traces", "t2", T3, None), ("steps", "t1", T3, None)],
    )
    assert found(t) == [
        ("steps", "s2", "deleted"), ("steps", "s3", "missing"), ("traces", "t2", "deleted"), ("traces", "t3", "missing"), ("traces", "t4", "missing"), ("traces", "t5", "missing"), ("traces", "t6", "late"), ("triage_labels", "T9", "missing"),
    ]
    assert {(r.table_name, r.month, r.reason): r.n_rows for r in I.orphan_report(I.orphans(t)).collect()}[("traces", "2025-03", "missing")] == 3


def test_empty_tables(spark):
    assert found(tables(spark)) == []
    assert found(tables(spark, steps=[("s", "t", T1)])) == [("steps", "s", "missing")]


def test_fold_is_incremental(spark):
    t = tables(spark, runs=[("r1", T2)], traces=[("t1", "r1", T1), ("t2", "r2", T3)])
    refs, parents = I.reference_deltas(I.reference_rows(t["traces"], "traces")), I.parent_deltas(t["runs"], "runs", "run_id")
    once, stepwise = I.fold(refs, parents), I.fold(I.fold(refs), parents)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, stepwise.collect()))
    assert {r.ref_key: r.fault for r in I.faulty_keys(stepwise).collect()} == {"r1": "late", "r2": "missing"}

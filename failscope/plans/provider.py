"""External calls as an operator: a provider maps requests to replies inside mapInPandas, and finished work is never asked again.

A provider is any picklable callable from a list of requests to a list of (reply, input_tokens,
output_tokens). Failures are retried with growing pauses and end as rows with an error, so one bad
request never fails a task. `resume` leaves out what a log of earlier replies already holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions.text import parse_action
from failscope.operators.windows import last_wins
from failscope.session import table

Provider = Callable[[list[str]], list[tuple[str, int, int]]]


def ask(requests: DataFrame, provider: Provider, key: list[str], prompt: str, tries: int = 3, pause: float = 10.0, batch: int = 64) -> DataFrame:
    """(key..., reply, input_tokens, output_tokens, error): one row a request, in Arrow batches on the executors."""
    keyed = requests.select(*key, F.col(prompt).alias("__prompt"))
    schema = ", ".join(f"`{k}` {keyed.schema[k].dataType.simpleString()}" for k in key) + ", reply string, input_tokens bigint, output_tokens bigint, error string"

    def attempt(prompts: list[str]) -> list[tuple]:
        for n in range(tries):
            try:
                return [(*r, None) for r in provider(prompts)]
            except Exception as e:  # noqa: BLE001 a provider may raise anything
                last = repr(e)
                if n + 1 < tries:
                    time.sleep(pause * 2**n)
        if len(prompts) > 1:  # find the request at fault
            return [x for p in prompts for x in attempt([p])]
        return [(None, 0, 0, last)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                got = pd.DataFrame(attempt(part["__prompt"].tolist()), columns=["reply", "input_tokens", "output_tokens", "error"])
                yield pd.concat([part[key].reset_index(drop=True), got], axis=1)

    return keyed.mapInPandas(run, schema)


def resume(requests: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Requests whose key the log has no reply without error for."""
    return requests.join(log.filter("error is null").select(*key), key, "left_anti")


def split_errors(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    return replies.filter("error is null").drop("error"), replies.filter("error is not null").select(*[c for c in replies.columns if c not in ("reply",)])


class KeywordProvider:
    """An offline provider: the action whose cue words the prompt has most of."""

    CUES = {"TOOL_FIX": ("tool", "status", "import"), "RETRIEVE_MORE": ("search", "page", "sources"), "REPLAN": ("plan", "condition"), "RETRY": ("again", "attempt"), "ESCALATE": ("person", "conflict"), "LOCAL_REPAIR": ("corrected", "line")}

    def __call__(self, prompts: list[str]) -> list[tuple[str, int, int]]:
        out = []
        for p in prompts:
            low = p.lower()
            best = max(self.CUES, key=lambda a: (sum(low.count(w) for w in self.CUES[a]), a))
            out.append((f"Action: {best}", len(p) // 4, 5))
        return out


def classify_with_provider(spark: SparkSession, d: str) -> DataFrame:
    """Labels that the offline provider gives to the rationales, against the stored action."""
    lab = last_wins(table(spark, d, "triage_labels"), ["trace_id"], ["ingested_at"]).filter("llm_1_rationale is not null")
    replies = ask(lab, KeywordProvider(), ["trace_id"], "llm_1_rationale")
    judged = replies.select("trace_id", parse_action(F.col("reply")).alias("action")).join(lab.select("trace_id", "llm_1_action"), "trace_id")
    return judged.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("action").eqNullSafe(F.col("llm_1_action")).cast("int")).alias("n_same"))


QUERIES = {"provider_labels": classify_with_provider}
SQL: dict[str, str] = {}

"""Classifiers over trace texts and structured features: TF-IDF, scaling, linear, kernel and tree models, baselines, input ablations, transfer.

Text statistics are relational (counts and joins); models are Spark ML estimators, which train by
aggregation over the executors. Vocabulary, document frequencies, means and deviations are fitted on
training rows only. What reaches the driver: a vocabulary of at most MAX_TERMS terms, labels, domains and scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.functions.text import ACTIONS, DOMAIN_NAMES, full_trace, normal_label, stored_views, trace_features, with_steps
from failscope.operators import logistic, relational
from failscope.operators.agreement import evaluate, per_class
from failscope.operators.windows import resolved_splits, stratified_split
from failscope.session import checkpointed, stored

#: terms kept by tf-idf, the document frequency below and above which terms are left out, and words in a term at most
MAX_TERMS, MIN_DF, MAX_DF, NGRAMS = 10_000, 2, 0.95, 2
#: rows of a domain from which it is held out
LEAST_ROWS = 10
VARIANTS = ["full_trace", "final_answer_only", "verifier_feedback_only", "trace_stats_only", "causal_neighborhood"]


# text features


def terms(text, ngrams: int = NGRAMS):
    """The lower-case words of two or more letters of a text, and their n-grams, as an array."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    def grams(n: int):
        more = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, more).otherwise(F.slice(w, 1, 0))

    return F.concat(w, *[grams(n) for n in range(2, ngrams + 1)])


def term_counts(df: DataFrame, key: str, text: str, ngrams: int = NGRAMS) -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(terms(F.col(text), ngrams)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, idx, idf, df, total) of the most frequent terms; smoothed idf ln((1+n)/(1+df))+1."""
    return top_terms(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), n_docs, max_terms)


def top_terms(frequencies: DataFrame, n_docs: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """The vocabulary of counted terms (term, df, total)."""
    v = frequencies.filter((F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF * n_docs))
    top = v.orderBy(F.col("total").desc(), "term").limit(max_terms)  # the feature: a vocabulary of max_terms
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"), "df", "total")


def tfidf_weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, idx, term, weight): (1+ln tf)*idf, scaled to length one by row. The vocabulary has at most MAX_TERMS rows, so it may be broadcast."""
    w = counts.join(F.broadcast(vocab), "term").select(key, "idx", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "idx", "term", (F.col("w") / F.col("norm")).alias("weight"))


def fit_vocabulary(train: DataFrame, text: str) -> list[tuple[str, float]]:
    """(term, idf) of the training rows, at most MAX_TERMS; one row a key."""
    return [(r.term, r.idf) for r in top_terms(logistic.document_frequencies(train, text, NGRAMS), train.count()).orderBy("idx").select("term", "idf").collect()]


def with_text_vectors(df: DataFrame, text: str, vocab: list[tuple[str, float]], out: str) -> DataFrame:
    """`df` with the tf-idf vector of a text, made without a shuffle: counts of known terms, logarithms, idf, length one."""
    counted = CountVectorizerModel.from_vocabulary([t for t, _ in vocab], inputCol="terms_", outputCol="counts_").transform(df.withColumn("terms_", terms(F.col(text))))
    logs = F.transform(vector_to_array("counts_"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))
    weighed = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in vocab]), inputCol="logs_", outputCol="weights_").transform(counted.withColumn("logs_", array_to_vector(logs)))
    scaled = Normalizer(p=2.0, inputCol="weights_", outputCol="unit_").transform(weighed)
    return VectorAssembler(inputCols=["unit_"], outputCol=out).transform(scaled).drop("terms_", "counts_", "logs_", "weights_", "unit_")  # the assembler stores it sparse


# structured features and datasets


def standardised(df: DataFrame, columns: list[str], train) -> DataFrame:
    """Columns less their training mean over their training deviation (population; one where it is zero)."""
    stats = df.filter(train).agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    scaled = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *scaled)  # one row


def domain_key(col):
    """A domain without letter case, signs and white space, since they are spelt unevenly; ? where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("?"))


def feature_columns() -> dict:
    """Feature name -> double column over a trace with its steps; see trace_features."""
    return trace_features() | {f"domain_{x}": (domain_key(F.col("domain")) == x.lower()).cast("double") for x in sorted(set(DOMAIN_NAMES.values()))}


def structured_features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """(trace_id, features...) of all traces in order of their names, and the names: steps, tools, lengths, domain, repairs."""
    t = with_steps(relational.traces(spark, d, "domain", "problem_statement", "final_answer"), relational.steps(spark, d, "trace_id", "step_index", "step_id", "step_type", "text", "tool_name", "tool_args_json", "tool_output_json", "tool_call_result", "has_tool"))
    rep = relational.labels(spark, d, "is_local_repairable", "num_successful_repair_steps").drop("ingested_at")
    cols = feature_columns()
    t = t.select("trace_id", *[c.alias(k) for k, c in cols.items()]).join(rep, "trace_id", "left")
    names = sorted([*cols, "is_local_repairable", "num_successful_repair_steps"])
    return t.select("trace_id", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]), names


def dataset(spark: SparkSession, d: str, views: bool = True) -> tuple[DataFrame, list[str]]:
    """(trace_id, domain, label, split, the five views if wanted, features...) of labelled traces, stored, and the features' names. Splits are the stored ones where all three are there."""
    lab = relational.labels(spark, d, "domain", "action_label", "split").select("trace_id", domain_key(F.col("domain")).alias("domain"), normal_label(F.col("action_label")).alias("label"), "split").filter("label is not null")
    lab = resolved_splits(lab, "label", "trace_id")
    features, names = structured_features(spark, d)
    return stored((lab.join(stored_views(spark, d), "trace_id") if views else lab).join(features, "trace_id")), names


def traces_dataset(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """As dataset() with the whole trace as the only view, stored; steps of labelled traces alone are gathered, once for text and features."""
    repairs = ["is_local_repairable", "num_successful_repair_steps"]
    lab = relational.labels(spark, d, "domain", "action_label", "split", *repairs).select("trace_id", domain_key(F.col("domain")).alias("domain"), normal_label(F.col("action_label")).alias("label"), "split", *repairs).filter("label is not null")
    lab = checkpointed(resolved_splits(checkpointed(lab), "label", "trace_id"))
    shown = ("step_type", "text", "tool_name", "tool_output_json", "tool_call_result", "has_tool")
    own = lab.select("trace_id")
    t = relational.traces(spark, d, "domain", "problem_statement", "final_answer").join(own, "trace_id", "left_semi")
    s = relational.steps(spark, d, "trace_id", "step_index", *shown).join(own, "trace_id", "left_semi")
    cols = feature_columns()
    names = sorted([*cols, *repairs])
    views = with_steps(t, s, shown).select("trace_id", full_trace().alias("full_trace"), *[c.alias(k) for k, c in cols.items()])
    return stored(lab.join(views, "trace_id").select("trace_id", "domain", "label", "split", "full_trace", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])), names


def assembled(data: DataFrame, train: DataFrame, text: str | None, names: list[str]) -> DataFrame:
    """`data` with `features`: the tf-idf of a view, fitted on `train`, before standardised structured features; either may be left out."""
    parts = []
    out = data
    if text is not None and (vocab := fit_vocabulary(train, text)):
        out, parts = with_text_vectors(out, text, vocab, "text_"), ["text_"]
    if names:
        stats = train.agg(*[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
        scaled = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(f"z_{c}") for c in names]
        out = out.crossJoin(F.broadcast(stats)).select(*out.columns, *scaled)  # one row
        parts += [f"z_{c}" for c in names]
    return VectorAssembler(inputCols=parts, outputCol="features").transform(out).select("trace_id", "domain", "label", "split", "features")


def weighted(df: DataFrame) -> DataFrame:
    """Balanced row weights n / (classes * rows of the class)."""
    per = df.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    n = per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return df.join(F.broadcast(per.crossJoin(n).select("label", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))), "label")  # labels


# models


def models(n_train: int, boosting_rounds: int = 300) -> dict:
    """Estimators by name: logistic regression (C = 1), a forest of 200 trees, a linear machine, gradient boosting (an own binary model for each label)."""
    own = {"featuresCol": "features", "labelCol": "y"}
    return {
        "logreg": lambda: LogisticRegression(**own, weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / max(n_train, 1), maxIter=1000, tol=1e-4),
        "forest": lambda: RandomForestClassifier(**own, weightCol="weight", numTrees=200, seed=42),
        "svm": lambda: OneVsRest(classifier=LinearSVC(standardization=False, regParam=1.0 / max(n_train, 1), maxIter=100, tol=1e-4), weightCol="weight", **own),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=boosting_rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, seed=42), **own),
    }


def fit_predict(train: DataFrame, test: DataFrame, model: str, **settings) -> DataFrame:
    """(trace_id, domain, label, predicted) of the test rows."""
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    fitted = models(train.count(), **settings)[model]().fit(weighted(index.transform(train)))
    names = F.array(*[F.lit(x) for x in index.labels])
    out = fitted.transform(test)
    return out.select("trace_id", "domain", "label", F.try_element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"))


def rbf_features(df: DataFrame, column: str, width: int, gamma: float, dimensions: int = 512, seed: int = 42) -> DataFrame:
    """`df` with `features`: random Fourier features of an array column, whose products approximate the radial kernel exp(-gamma |x-y|^2) (Arrow batches)."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(0.0, np.sqrt(2 * gamma), (width, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)

    @F.pandas_udf("array<double>")
    def lifted(x: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / dimensions) * np.cos(np.stack([np.asarray(v, dtype=float) for v in x]) @ w + shift) if len(x) else np.zeros((0, dimensions))
        return pd.Series(list(z))

    return df.withColumn("features", array_to_vector(lifted(F.col(column))))


def majority_prediction(train: DataFrame, test: DataFrame, by: str | None = None) -> DataFrame:
    """The most frequent training label, overall or of the row's group."""
    c = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    overall = c.agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("all_"))
    out = test.crossJoin(F.broadcast(overall))  # one row
    if by is None:
        return out.select("trace_id", "domain", "label", F.col("all_").alias("predicted"))
    g = train.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("own"))
    return out.join(g, by, "left").select("trace_id", "domain", "label", F.coalesce("own", "all_").alias("predicted"))


def _scores(pred: DataFrame, method: str) -> DataFrame:
    return evaluate(pred.withColumn("method", F.lit(method)), "label", "predicted", ["method"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# queries


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the baselines on the test rows: the majority, each domain's majority, and (an upper bound) each domain's majority among the test rows."""
    lab = relational.labels(spark, d, "domain", "action_label", "split").select("trace_id", domain_key(F.col("domain")).alias("domain"), normal_label(F.col("action_label")).alias("label"), "split").filter("label is not null")
    data = checkpointed(resolved_splits(lab, "label", "trace_id"))
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    return _union([_scores(majority_prediction(train, test), "majority"), _scores(majority_prediction(train, test, "domain"), "domain_mode"), _scores(majority_prediction(test, test, "domain"), "oracle_domain_mode")])


def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and F1 on the test rows of logistic regression over the whole trace's text with structured features."""
    data, names = traces_dataset(spark, d)
    train = data.filter("split = 'train'")
    vocab = fit_vocabulary(train, "full_trace")
    scaled = standardised(data.filter("split in ('train', 'test')"), names, F.col("split") == "train")
    x = stored(logistic.with_sparse_vectors(scaled, "full_trace", vocab, names, ["trace_id", "domain", "label", "split"], NGRAMS))
    labels, w, _ = logistic.fitted(x.filter("split = 'train'"), len(vocab), len(names))
    return _scores(logistic.predicted(x.filter("split = 'test'"), labels, w, len(vocab), ["trace_id", "domain", "label"]), "logreg")


def input_ablations(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 on the test rows for each view of the traces alone, and the better model; a tie goes to logistic regression."""
    data, _ = dataset(spark, d)
    parts = []
    for variant in VARIANTS:
        x = stored(assembled(data, data.filter("split = 'train'"), variant, []))
        train, test = x.filter("split = 'train'"), x.filter("split = 'test'")
        parts += [_scores(fit_predict(train, test, m), m).withColumn("input_variant", F.lit(variant)) for m in ("logreg", "forest")]
        parts.append(_scores(majority_prediction(train, test, "domain"), "domain_only").withColumn("input_variant", F.lit(variant)))
    wide = _union(parts).groupBy("input_variant").pivot("method", ["logreg", "forest", "domain_only"]).agg(F.first("macro_f1"))
    return wide.select("input_variant", *[F.col(m).alias(f"{m}_macro_f1") for m in ("logreg", "forest", "domain_only")], F.greatest("logreg", "forest").alias("best_macro_f1"), F.when(F.col("logreg") >= F.col("forest"), "logreg").otherwise("forest").alias("best_model"))


def held_out_domains(data: DataFrame, least: int = LEAST_ROWS) -> list[str]:
    """All domains with enough rows; what is collected are domains, not rows."""
    return [r[0] for r in data.groupBy("domain").count().filter(F.col("count") >= least).orderBy("domain").collect()]


def transfer_predictions(spark: SparkSession, d: str, model: str = "logreg", view: str | None = "full_trace") -> DataFrame:
    """(held_out, method, trace_id, domain, label, predicted): each domain predicted by models fitted on all others; vocabulary and scaling are fitted anew each time. Without a view, structured features alone."""
    data, names = dataset(spark, d, view is not None)
    parts = []
    for x in held_out_domains(data):
        rest, own = data.filter(F.col("domain") != x), data.filter(F.col("domain") == x)
        both = stored(assembled(data, rest, view, names))
        train, test = both.filter(F.col("domain") != x), both.filter(F.col("domain") == x)
        for method, p in ((model, fit_predict(train, test, model)), ("majority", majority_prediction(rest, own)), ("oracle_domain_mode", majority_prediction(own, own))):
            parts.append(p.withColumn("held_out", F.lit(x)).withColumn("method", F.lit(method)))
    if not parts:
        return data.select(F.col("domain").alias("held_out"), F.lit(model).alias("method"), "trace_id", "domain", "label", F.col("label").alias("predicted")).filter(F.lit(False))
    return checkpointed(_union(parts))


def cross_domain(spark: SparkSession, d: str, view: str | None = None) -> DataFrame:
    """Leave one domain out: scores of each method on each held-out domain."""
    return evaluate(transfer_predictions(spark, d, view=view), "label", "predicted", ["held_out", "method"])


def action_transfer(spark: SparkSession, d: str, view: str | None = None) -> DataFrame:
    """Mean F1 of each action over the held-out domains."""
    p = per_class(transfer_predictions(spark, d, view=view), "label", "predicted", ["held_out", "method"])
    return p.groupBy("method", F.col("label").alias("action")).agg(F.round(F.avg("f1"), 4).alias("mean_f1"), F.count(F.lit(1)).alias("n_domains"))


def transfer_gap(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 within domains less its mean over held-out domains."""
    data, names = dataset(spark, d)
    x = assembled(data, data.filter("split = 'train'"), "full_trace", names)
    inside = _scores(fit_predict(x.filter("split = 'train'"), x.filter("split = 'test'"), "logreg"), "logreg").select("method", F.col("macro_f1").alias("in_domain_macro_f1"))
    outside = cross_domain(spark, d, "full_trace").groupBy("method").agg(F.round(F.avg("macro_f1"), 4).alias("mean_heldout_macro_f1"))
    return inside.join(outside, "method").withColumn("transfer_gap", F.round(F.col("in_domain_macro_f1") - F.col("mean_heldout_macro_f1"), 4))


def _rationales(spark, d):
    """Rationales of labelled traces with a repeatable split."""
    lab = relational.labels(spark, d, "llm_1_rationale", "action_label").filter("llm_1_rationale is not null and action_label is not null").select("trace_id", "llm_1_rationale", "action_label")
    return stratified_split(lab, "action_label", "trace_id")


def tfidf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of words and word pairs fitted on the training rationales."""
    train = checkpointed(_rationales(spark, d).filter("split = 'train'"))
    return vocabulary(term_counts(train, "trace_id", "llm_1_rationale"), train.count()).select("term", F.round("idf", 6).alias("idf"), "df", "total")


def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The weightiest term of each rationale; the vocabulary is fitted on training rows."""
    rows = checkpointed(_rationales(spark, d))
    train = rows.filter("split = 'train'")
    vocab = checkpointed(vocabulary(term_counts(train, "trace_id", "llm_1_rationale"), train.count()))
    w = tfidf_weights(term_counts(rows, "trace_id", "llm_1_rationale"), vocab, "trace_id").withColumn("weight", F.round("weight", 6))
    return w.groupBy("trace_id").agg(F.min_by(F.struct("term", "weight"), F.struct(-F.col("weight"), "term")).alias("t")).select("trace_id", "t.term", "t.weight")


def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a linear model on stored embeddings, a fifth of the rows held out by hash."""
    e = relational.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("trace_id"), F.lit("embeddings").alias("domain"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    e = checkpointed(e.filter("label is not null and x is not null").withColumn("fold", F.pmod(F.xxhash64("trace_id"), F.lit(5))))
    x = e.withColumn("features", array_to_vector("x"))
    return _scores(fit_predict(x.filter("fold <> 0"), x.filter("fold = 0"), "logreg"), "logreg")


QUERIES = {f.__name__: f for f in (baseline_scores, classifier_scores, cross_domain, tfidf_vocabulary, tfidf_top_terms, embedding_neighbours)}

_LATEST = "with l0 as (select * from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn_ from triage_labels) where rn_ = 1)"
_RATIONALES = _LATEST + r""", l as (select trace_id, llm_1_rationale, action_label from l0 where llm_1_rationale is not null and action_label is not null),
    h as (select *, count(*) over (partition by action_label) n, row_number() over (partition by action_label order by md5('42:' || trace_id), trace_id) rk from l),
    x as (select trace_id, llm_1_rationale t, case when n < 3 then 'train' when n < 10 then case when rk = n then 'test' when rk = n - 1 then 'dev' else 'train' end when rk <= greatest(1, round_even(n * 0.1, 0)) then 'test' when rk <= 2 * greatest(1, round_even(n * 0.1, 0)) then 'dev' else 'train' end as split from h),
    w as (select trace_id, split, regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}') ws from x),
    g as (select trace_id, split, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) term from w),
    c as (select trace_id, split, term, count(*) tf from g group by 1, 2, 3), n as (select count(*) n from x where split = 'train'),
    v as (select term, count(*) df, sum(tf) total, ln((1.0::double + n) / (1.0::double + count(*))) + 1 idf from c, n where split = 'train' group by term, n having count(*) >= 2 and count(*) <= 0.95 * n order by total desc, term limit 10000)
"""
_BASE = _LATEST + r""", a as (select trace_id, coalesce(nullif(regexp_replace(lower(domain), '[^\p{L}\p{N}]', '', 'g'), ''), '?') domain, regexp_replace(split_part(replace(replace(replace(upper(action_label), 'ESCELATE', 'ESCALATE'), 'REPPLAN', 'REPLAN'), 'REPAN', 'REPLAN'), '/', 1), '^\s+|\s+$', '', 'g') as label, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) s from l0),
    b as (select trace_id, domain, label, case when s = 'validation' then 'dev' when s in ('train', 'dev', 'test') then s end s from a where label in ('RETRY', 'REPLAN', 'RETRIEVE_MORE', 'TOOL_FIX', 'ESCALATE', 'LOCAL_REPAIR')),
    tr as (select * from b where s = 'train'), te as (select * from b where s = 'test'), m as (select label from tr group by 1 order by count(*) desc, label limit 1),
    md as (select domain, label from (select domain, label, row_number() over (partition by domain order by count(*) desc, label) k from tr group by 1, 2) where k = 1), mt as (select domain, label from (select domain, label, row_number() over (partition by domain order by count(*) desc, label) k from te group by 1, 2) where k = 1),
    p as (select 'majority' "method", te.label y, m.label z from te, m union all select 'domain_mode', te.label, coalesce(md.label, m.label) from te cross join m left join md using (domain) union all select 'oracle_domain_mode', te.label, mt.label from te join mt using (domain)),
    q as (select "method", x, sum(tp) tp, sum(fp) fp, sum(fn) fn from (select "method", y x, cast(y = z as int) tp, 0 fp, cast(y <> z as int) fn from p union all select "method", z, 0, 1, 0 from p where y <> z) group by 1, 2),
    f as (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, tp + fn sup from q)
    select "method", sum(sup) n, round(sum(tp) * 1.0 / sum(sup), 4) accuracy, round(avg(f1), 4) macro_f1, round(sum(f1 * sup) / sum(sup), 4) weighted_f1 from f group by 1"""
SQL = {
    "baseline_scores": _BASE,
    "tfidf_vocabulary": _RATIONALES + "select term, round(idf, 6) idf, df, total from v",
    "tfidf_top_terms": _RATIONALES + """, y as (select trace_id, term, (1 + ln(tf)) * idf w from c join v using (term)), z as (select trace_id, term, round(w / sqrt(sum(w * w) over (partition by trace_id)), 6) weight from y)
    select trace_id, term, weight from (select *, row_number() over (partition by trace_id order by weight desc, term) k from z) where k = 1""",
}

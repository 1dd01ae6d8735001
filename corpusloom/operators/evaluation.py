"""Evaluation metrics over ranked results, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio(a, b) -> object:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rank_metrics(ranked: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """A row per case (qid): tp, fp, fn, precision, recall, f1, hit_at_k, mrr, ap, ndcg.

    ranked: (qid, key, rank); expected: (qid, key), each once. A case without expected keys has recall 1 if nothing was
    returned. Every metric comes from one pass over the ranked rows, with a running count of the relevant ones."""
    exp = expected.groupBy("qid").agg(F.count("*").alias("n_exp"))
    rel = ranked.join(expected.withColumn("rel", F.lit(1)), ["qid", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rel = rel.withColumn("so_far", so_far)
    got = rel.groupBy("qid").agg(
        F.count("*").alias("n_pred"), F.sum("rel").alias("tp"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"), F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    m = cases.select("qid").join(exp, "qid", "left").join(got, "qid", "left").na.fill(0)
    ideal = F.aggregate(F.when(F.least("n_exp", "n_pred") > 0, F.sequence(F.lit(1), F.least("n_exp", "n_pred").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("n_pred")))
    m = m.withColumn("recall", F.when(F.col("n_exp") > 0, F.col("tp") / F.col("n_exp")).otherwise(F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)))
    return m.select(
        "qid", F.col("tp").cast("long").alias("tp"), (F.col("n_pred") - F.col("tp")).cast("long").alias("fp"), F.greatest(F.lit(0), F.col("n_exp") - F.col("tp")).cast("long").alias("fn"), "precision", "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), (F.col("tp") > 0).cast("double").alias("hit_at_k"), ratio(F.lit(1.0), F.col("first")).alias("mrr"),
        ratio(F.col("ap_sum"), F.col("n_exp")).alias("ap"), F.when(F.col("n_exp") > 0, ratio(F.col("dcg"), ideal)).otherwise(F.col("dcg")).alias("ndcg"),
    )


def contains_recall(cases: DataFrame, found: DataFrame, normal) -> DataFrame:
    """(qid, matched, recall): whether some text that was returned (qid, text) holds what the case (qid, query) expects, both
    normalised."""
    met = found.join(cases, "qid").where(F.contains(normal(F.col("text")), normal(F.col("query")))).groupBy("qid").agg(F.count("*").alias("n"))
    hit = F.col("n").isNotNull()
    return cases.select("qid").join(met, "qid", "left").select("qid", hit.cast("long").alias("matched"), hit.cast("double").alias("recall"))


def summarise(metrics: DataFrame) -> DataFrame:
    """One row: counts, micro precision, recall and f1 over all rows, and macro means."""
    s = metrics.agg(F.count("*").alias("cases"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "hit_at_k", "mrr", "ap", "ndcg")))
    s = s.withColumn("micro_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("micro_f1", ratio(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))


def by_label(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per label of (qid, labels array): cases and macro means; cases without labels are `__unlabeled__`."""
    none = F.array(F.lit("__unlabeled__"))
    held = metrics.join(labels, "qid", "left").withColumn("label", F.explode(F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, F.col("labels")).otherwise(none)))
    return held.groupBy("label").agg(F.count("*").alias("cases"), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "mrr", "ndcg")))


def token_multiset_f1(pairs: DataFrame, tokens_of) -> DataFrame:
    """(case_id, overlap, precision, recall, f1) of (case_id, expected, actual): tokens as multisets."""
    side = lambda c, n: pairs.select("case_id", F.explode(tokens_of(F.col(c))).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias(n))
    met = side("expected", "a").join(side("actual", "b"), ["case_id", "term"], "full").na.fill(0)
    s = pairs.select("case_id").join(met.groupBy("case_id").agg(F.sum(F.least("a", "b")).alias("overlap"), F.sum("a").alias("n_exp"), F.sum("b").alias("n_act")), "case_id", "left").na.fill(0)
    s = s.withColumn("precision", ratio(F.col("overlap"), F.col("n_act"))).withColumn("recall", ratio(F.col("overlap"), F.col("n_exp")))
    return s.select("case_id", "overlap", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def variant_vs_baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """(variant, cases, wins, ties, losses, mean_delta) of (case_id, variant, score) against the baseline's same cases."""
    base = rows.where(F.col("variant") == baseline).select("case_id", F.col("score").alias("base"))
    met = rows.where(F.col("variant") != baseline).join(base, "case_id")
    return met.groupBy("variant").agg(F.count("*").alias("cases"), F.count_if(F.col("score") > F.col("base")).alias("wins"), F.count_if(F.col("score") == F.col("base")).alias("ties"), F.count_if(F.col("score") < F.col("base")).alias("losses"), F.avg(F.col("score") - F.col("base")).alias("mean_delta"))


def common_cases(rows: DataFrame) -> DataFrame:
    """(run, case_id) rows of those cases that every run has."""
    runs = rows.agg(F.count_distinct("run").alias("n_runs"))
    held = rows.groupBy("case_id").agg(F.count_distinct("run").alias("n")).crossJoin(F.broadcast(runs)).where("n = n_runs")
    return rows.join(held.select("case_id"), "case_id", "left_semi")


def agentic_score(rows: DataFrame, ok_weight: float = 0.35, pass_weight: float = 0.5, speed_weight: float = 0.15, reference_ms: float = 150.0) -> DataFrame:
    """`rows` (ok, pass_rate, elapsed_ms) with score: weighted success, assertions passed and speed 1 / (1 + t / reference)."""
    speed = 1 / (1 + F.greatest(F.lit(0.0), F.col("elapsed_ms")) / reference_ms)
    return rows.withColumn("score", ok_weight * F.col("ok").cast("double") + pass_weight * F.col("pass_rate") + speed_weight * speed)

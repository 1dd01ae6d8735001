"""Summaries of evaluation runs: judged answers, pairwise preferences, variants, statuses, and the structure of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.evaluation import ratio

# fixed values: spellings of each status; anything else is nicht_belegt
STATUSES = {"belegt": ("belegt", "supported", "ja", "yes"), "teilweise": ("teilweise", "partially", "partial"), "widerspruch": ("widerspruch", "contradiction", "conflict")}


def normal_status(status: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(status, F.lit(""))))
    out = F.lit("nicht_belegt")
    for name, spelled in STATUSES.items():
        out = F.when(low.isin(*spelled), name).otherwise(out)
    return out


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """(status, n) over the normalised statuses."""
    return rows.groupBy(normal_status(F.col(status)).alias("status")).agg(F.count("*").alias("n"))


def judged(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of (correct, parsed, confidence, duration_ms): counts, accuracy, means, and whether accuracy reaches the
    threshold. Null confidences are left out of their mean; without rows all is 0 and false."""
    s = rows.agg(F.count("*").alias("cases"), F.count_if("correct").alias("correct"), F.count_if("parsed").alias("n_parsed"), F.avg("confidence").alias("avg_confidence"), F.avg("duration_ms").alias("avg_duration_ms"))
    accuracy = ratio(F.col("correct"), F.col("cases"))
    return s.select("cases", "correct", (F.col("cases") - F.col("correct")).alias("incorrect"), accuracy.alias("accuracy"), ratio(F.col("n_parsed"), F.col("cases")).alias("parsed_rate"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_confidence", "avg_duration_ms")), ((F.col("cases") > 0) & (accuracy >= threshold)).alias("passed"))


def compared(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row of (preferred: a, b or else, parsed): counts and rates of each preference, the winner, and whether the gap is
    over the threshold."""
    s = rows.agg(F.count("*").alias("cases"), F.count_if(F.col("preferred") == "a").alias("preferred_a"), F.count_if(F.col("preferred") == "b").alias("preferred_b"), F.count_if("parsed").alias("parsed"))
    s = s.withColumn("win_gap", ratio(F.col("preferred_a"), F.col("cases")) - ratio(F.col("preferred_b"), F.col("cases")))
    winner = F.when(F.col("win_gap") > 0, "A").when(F.col("win_gap") < 0, "B").otherwise("tie")
    return s.select("cases", "preferred_a", "preferred_b", (F.col("cases") - F.col("preferred_a") - F.col("preferred_b")).alias("undecided"), "parsed", ratio(F.col("parsed"), F.col("cases")).alias("parsed_rate"), "win_gap", winner.alias("winner"), (F.abs("win_gap") > threshold).alias("passed"))


def variants(scored: DataFrame) -> DataFrame:
    """(variant, cases, ok_rate, mean_elapsed_ms, mean_pass_rate, mean_score, total_score) of scored rows."""
    return scored.groupBy("variant").agg(F.count("*").alias("cases"), F.avg(F.col("ok").cast("double")).alias("ok_rate"), F.avg("elapsed_ms").alias("mean_elapsed_ms"), F.avg("pass_rate").alias("mean_pass_rate"), F.avg("score").alias("mean_score"), F.sum("score").alias("total_score"))


def best_run(rows: DataFrame, by: str, run: str, metric: str) -> DataFrame:
    """(by, run, metric) of the run with the largest metric, ties to the smallest run."""
    best = rows.groupBy(by).agg(F.min(F.struct((-F.col(metric)).alias("m"), F.col(run).alias("r"))).alias("best"))
    return best.select(by, F.col("best.r").alias(run), (-F.col("best.m")).alias(metric))


# fixed values: what counts as a line of each kind
KINDS = {"heading": r"(?m)^\s{0,3}#{1,6}\s+", "list": r"(?m)^\s*(?:[-+*]|\d+[.)])\s+", "table_line": r"(?m)^\s*\|.*\|\s*$", "page_marker": r"(?im)^\[Seite\s+\d+\]\s*$"}


def structure_deltas(pairs: DataFrame) -> DataFrame:
    """`pairs` (expected, actual) with how many more line ends, headings, list items, table lines and page markers the actual
    text has, and the tags that tell of a drift."""
    more = {f"{k}_delta": F.regexp_count("actual", F.lit(p)) - F.regexp_count("expected", F.lit(p)) for k, p in {"newline": "\n", **KINDS}.items()}
    d = pairs.withColumns(more)
    far = lambda c, n: F.abs(c) >= n
    told = [("too_many_line_breaks", F.col("newline_delta") > 8), ("too_few_line_breaks", F.col("newline_delta") < -8), ("heading_structure_drift", far("heading_delta", 2)), ("list_structure_drift", far("list_delta", 2)), ("table_structure_drift", far("table_line_delta", 2)), ("page_marker_drift", far("page_marker_delta", 1))]
    return d.withColumn("tags", F.array_compact(F.array(*(F.when(c, t) for t, c in told))))


def asserted(value: Column, op: str, expected) -> Column:
    """An assertion about a value, null where there is none: exists, equals, not_equals, contains, len_gte, len_lte, gte, lte.
    Numbers are compared as such; what is no number fails. An unknown op fails."""
    number = value.try_cast("double")
    ops = {
        "exists": lambda: value.isNotNull(), "equals": lambda: value.eqNullSafe(F.lit(expected)), "not_equals": lambda: ~value.eqNullSafe(F.lit(expected)), "contains": lambda: F.contains(value, F.lit(str(expected))),
        "len_gte": lambda: F.coalesce(F.length(value), F.lit(-1)) >= int(expected), "len_lte": lambda: F.coalesce(F.length(value), F.lit(-1)) <= int(expected), "gte": lambda: number >= float(expected), "lte": lambda: number <= float(expected),
    }
    return F.coalesce(ops[op](), F.lit(False)) if op in ops else F.lit(False)

"""Keeping tables up to date: corpus sync, first-wins merges, running state, feedback counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_sync(old: DataFrame, new: DataFrame, key: str = "name", text: str = "content") -> DataFrame:
    """(key, action): added, changed, same or removed, by the hash of the content. One full outer join of hashes."""
    a = old.select(F.col(key).alias("key"), F.sha1(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("a"))
    b = new.select(F.col(key).alias("key"), F.sha1(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("b"))
    action = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "key", "full").select("key", action.alias("action"))


def first_wins(rows: DataFrame, key, pos: str) -> DataFrame:
    """The first row by `pos` of each key: a minimum of structs, so the map side already keeps one row a key."""
    held = rows.withColumn("__k", key).groupBy("__k").agg(F.min(F.struct(pos, *(c for c in rows.columns if c != pos))).alias("r"))
    return held.select("r.*").select(*rows.columns)


def latest_state(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """`rows` with each of `columns` filled by its last value so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{c}_now": F.last(c, ignorenulls=True).over(w) for c in columns})


USE_CASES = ("view", "signup", "click", "error", "purchase")


def feedback(events: DataFrame) -> DataFrame:
    """Events as feedback: use_case (unknown ones `other`), sentiment, ts. An error or a negative value is negative."""
    use = F.when(F.col("event_type").isin(*USE_CASES), F.col("event_type")).otherwise("other")
    mood = F.when((F.col("event_type") == "error") | (F.col("value") < 0), "negative").otherwise("positive")
    return events.select("event_id", "ts", "user_id", use.alias("use_case"), mood.alias("sentiment"))


def feedback_counters(events: DataFrame) -> DataFrame:
    """(use_case, day, n, negative, last_ts): the totals over all, by use case and by day, as grouping sets of one scan."""
    f = feedback(events).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sets = f.groupingSets([[], ["use_case"], ["day"]], "use_case", "day")
    return sets.agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("negative"), F.max("ts").alias("last_ts"), F.grouping_id().alias("level"))

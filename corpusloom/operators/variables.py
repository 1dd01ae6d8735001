"""Variables in texts: placeholders of two forms and the values they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch

# fixed values: the first form of a placeholder, and the second, which is looked for in what the first pass made
FORMS = (r"\$\{([^{}]+)\}", r"\{\{\s*([^{}]+?)\s*\}\}")

# names with a value that are handed to all tasks
MOST_NAMES = 500_000


def canonical(name: Column) -> Column:
    """A name in lower case, with one underscore for each run of other characters than letters and digits of ASCII, none at its ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def _values(names: DataFrame, variables: DataFrame) -> DataFrame:
    """(name, value) for the distinct `names` that a variable has: in the same spelling, else but for case, else in canonical form;
    of several that fit the first."""
    known = variables.select("place", F.trim("name").alias("known"), F.coalesce("value", F.lit("")).alias("value")).where("known <> ''")
    # of equal names the last value counts, at the place of the first
    known = known.groupBy("known").agg(F.min("place").alias("place"), F.max_by("value", "place").alias("value"))
    out = names.select("name").distinct()
    for i, form in enumerate((lambda c: c, F.lower, canonical)):
        first = known.groupBy(form(F.col("known")).alias("form")).agg(F.min_by("value", "place").alias(f"v{i}")).where("form <> ''")
        out = out.join(first, form(F.col("name")) == F.col("form"), "left").drop("form")
    return out.select("name", F.coalesce("v0", "v1", "v2").alias("value")).where("value is not null")


def _passed(texts: DataFrame, variables: DataFrame, form: str, scratch: Scratch) -> DataFrame:
    """`texts` (key, text, used, missing) with the placeholders of one form replaced. A text is cut at its placeholders; the distinct
    names meet the variables, and only they meet the pieces."""
    has = F.col("text").rlike(form)
    parts = F.arrays_zip(F.split("text", form, -1).alias("piece"), F.regexp_extract_all("text", F.lit(form), 1).alias("name"), F.regexp_extract_all("text", F.lit(form), 0).alias("whole"))
    each = texts.where(has).select("key", "used", "missing", F.posexplode(parts).alias("i", "p")).select("key", "used", "missing", "i", "p.piece", "p.whole", F.trim("p.name").alias("name"))
    each = scratch(each, "pieces")
    # a name that most texts have would be one task's work in a join that deals out by name
    known = scratch(_values(each.where("name <> ''"), variables), "known")
    told = each.join(F.broadcast(known) if known.count() <= MOST_NAMES else known, "name", "left")
    said = F.struct("i", F.concat("piece", F.coalesce("value", "whole", F.lit(""))).alias("said"), F.when(F.col("value").isNotNull(), F.col("name")).alias("hit"), F.when(F.col("value").isNull() & (F.col("name") != ""), F.col("name")).alias("miss"))
    held = told.groupBy("key", "used", "missing").agg(F.array_sort(F.collect_list(said)).alias("s"))
    more = lambda c, f: F.array_distinct(F.concat(c, F.array_compact(F.col(f"s.{f}"))))
    done = held.select("key", F.array_join("s.said", "").alias("text"), more("used", "hit").alias("used"), more("missing", "miss").alias("missing"))
    return texts.where(~has).unionByName(done)


def substituted(texts: DataFrame, variables: DataFrame) -> DataFrame:
    """(key, text, used, missing) of `texts` (key, text) with the placeholders that `variables` (place, name, value) know replaced, and the names
    that were and weren't found, in order. Values are not searched for placeholders of the first form. Keys are unique; null is empty."""
    none = F.array().cast("array<string>")
    out = texts.select("key", F.coalesce("text", F.lit("")).alias("text"), none.alias("used"), none.alias("missing"))
    scratch = Scratch(texts.sparkSession, "variables")
    first, second = FORMS
    out = scratch(_passed(out, variables, first, scratch), "first")
    scratch.drop("pieces", "known")
    return _passed(out, variables, second, scratch)

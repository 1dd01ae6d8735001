"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch, staged

# hash bits that the directory may use, and how many levels one pass over the bytes adds
MOST_BITS, PASS_BITS = 60, 12
LIMIT_BYTES = 1 << 20


def hash60(text) -> object:
    """60 bits of an MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def leaves(rows: DataFrame, base: int, limit_bytes: int) -> DataFrame:
    """(owner, fine, leaf) for rows (owner, h, bytes): the leaf, a struct of depth, slot, shard_bytes, shard_rows, above
    every bucket PASS_BITS levels below `base` that has one by then.

    The bytes are summed once, at the deepest level; the levels between are sums of these sums. A bucket's leaf is at
    the smallest depth at which its prefix fits, so exactly the oversized prefixes split. The prefixes of length `base`
    are oversized if base > 0.
    """
    deep = min(base + PASS_BITS, MOST_BITS)
    fine = rows.groupBy("owner", F.shiftright("h", MOST_BITS - deep).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    fine = staged(fine, "shard-sums")
    levels = fine.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in range(base + (base > 0), deep + 1)))))
    levels = levels.withColumn("slot", F.expr(f"shiftright(fine, {deep} - depth)"))
    sums = levels.groupBy("owner", "depth", "slot").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sums.where(F.col("shard_bytes") <= limit_bytes)
    leaf = F.min(F.struct("depth", "slot", "shard_bytes", "shard_rows")).alias("leaf")
    return levels.join(fits, ["owner", "depth", "slot"]).groupBy("owner", "fine").agg(leaf)


def _bits(slot, depth) -> object:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(slot), depth, "0"))


def split(rows: DataFrame, limit_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """Rows (owner, label, h, bytes, ...) with their shards, pass by pass, and the rows whose hash no bit can split."""
    done, base = [], 0
    while base < MOST_BITS:
        deep = min(base + PASS_BITS, MOST_BITS)
        at = rows.withColumn("fine", F.shiftright("h", MOST_BITS - deep))
        met = at.join(leaves(rows, base, limit_bytes), ["owner", "fine"], "left").drop("fine")
        met = staged(met, "shard-pass")
        leaf = F.col("leaf")
        shard = F.concat("label", _bits(leaf["slot"], leaf["depth"])).alias("shard")
        done.append(met.where("leaf is not null").select("key", "bytes", shard, leaf["depth"].alias("depth"), leaf["shard_bytes"].alias("shard_bytes"), leaf["shard_rows"].alias("shard_rows")))
        rows, base = met.where("leaf is null").drop("leaf"), deep
        if rows.isEmpty():
            break
    return done, rows


def assign_shards(df: DataFrame, key: str = "doc_id", payload: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """A row for each of `df`: its key, bytes, shard (the hash-prefix bits; '' if one shard holds all), depth,
    shard_bytes and shard_rows.

    A row's size is its payload in UTF-8 (null: 0). The hash is of the key (null as ''), so rows of one key meet. Where
    one key is over the limit by itself, no bit of its hash can split it: its rows split on by the bits of a hash of
    the payload (shard `<bits>+<bits>`), and equal payloads by count, as many as fit (`<bits>+<bits>#<n>`). A single
    row over the limit is a shard of its own. Other columns are not read; an empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("bytes"),
        F.lit(0).cast("long").alias("owner"),
        F.lit("").alias("label"),
        hash60(text(key)).alias("h"),
        hash60(text(payload)).alias("other"),
    )
    done, stuck = split(staged(rows, "shard-rows"), limit_bytes)
    if not stuck.isEmpty():
        again = stuck.select("key", "bytes", F.col("h").alias("owner"), F.concat(_bits(F.col("h"), F.lit(MOST_BITS)), F.lit("+")).alias("label"), F.col("other").alias("h"), F.lit(0).cast("long").alias("other"))
        more, equal = split(staged(again, "shard-keys"), limit_bytes)
        done += more
        # equal rows are counted, not gathered, and dealt out again by number
        each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("bytes", F.lit(1)))).cast("long")
        dealt = equal.groupBy("key", "bytes", "label", "h").agg(F.count("*").alias("n")).withColumn("each", each)
        dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("part", F.floor(F.col("i") / F.col("each")))
        held = F.least("each", F.col("n") - F.col("part") * F.col("each"))
        shard = F.concat("label", _bits(F.col("h"), F.lit(MOST_BITS)), F.lit("#"), F.col("part").cast("string"))
        done.append(dealt.select("key", "bytes", shard.alias("shard"), F.lit(2 * MOST_BITS).alias("depth"), (held * F.col("bytes")).alias("shard_bytes"), held.alias("shard_rows")))
    return reduce(DataFrame.union, done).withColumnRenamed("key", key)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", payload: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write every row of `df` under `path`, a folder `shard_id=<name>` for each shard; returns the assignment.

    The name is the shard's, with a letter before it. Rows of a key that is over the limit by itself have several shards: a
    row finds its own by the hash of its payload, and among equal rows by number (a column shard_id of `df` is left out). So no folder holds more than the limit,
    but for single rows over it, and no key is one task: rows are dealt out by shard."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scratch = Scratch(df.sparkSession, "shards")
    plan = scratch(assign_shards(df, key, payload, limit_bytes), "plan")
    names = plan.select(F.col(key).alias("__key"), F.col("bytes").alias("__bytes"), F.col("shard").alias("__shard"))
    whole = names.where("not contains(__shard, '+')").select("__key", "__shard").distinct()
    split_up = names.where("contains(__shard, '+')")
    rows = df.select(F.struct(*(c for c in df.columns if c != "shard_id")).alias("__row"), F.col(key).alias("__k"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("__size"), hash60(text(payload)).alias("__h"))
    plain = rows.join(whole, rows["__k"].eqNullSafe(whole["__key"])).drop("__key")
    # the bits of a payload's hash begin with those of its shard; a shard with a number holds equal rows only
    mine = split_up.select("__key", "__bytes", "__shard", F.regexp_extract("__shard", r"[+]([01]*)", 1).alias("__bits"), F.coalesce(F.regexp_extract("__shard", r"#(\d+)$", 1).try_cast("long"), F.lit(-1)).alias("__part")).distinct()
    hot = rows.join(split_up.select("__key").distinct(), rows["__k"].eqNullSafe(F.col("__key"))).drop("__key").withColumn("__hash", _bits(F.col("__h"), F.lit(MOST_BITS)))
    # the number of a row among the rows of its payload, counted task by task and then over the tasks
    hot = scratch(hot.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "hot")
    within = Window.partitionBy("__k", "__hash", "__size", "__task").orderBy("__at")
    counts = hot.groupBy("__k", "__hash", "__size", "__task").agg(F.count("*").alias("__n"))
    past = F.coalesce(F.sum("__n").over(Window.partitionBy("__k", "__hash", "__size").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__k").alias("__k2"), F.col("__hash").alias("__h2"), F.col("__size").alias("__s2"), F.col("__task").alias("__t2"), past.alias("__past"))
    numbered = hot.withColumn("__i", F.row_number().over(within) - 1).join(counts, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__hash") == F.col("__h2")) & (F.col("__size") == F.col("__s2")) & (F.col("__task") == F.col("__t2")))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("__size", F.lit(1)))).cast("long")
    numbered = numbered.withColumn("__place", F.floor((F.col("__past") + F.col("__i")) / each))
    fits = F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__size") == F.col("__bytes")) & F.col("__hash").startswith(F.col("__bits")) & F.col("__part").isin(-1, F.col("__place"))
    dealt = numbered.join(mine, fits)
    out = [x.select("__row.*", F.concat(F.lit("b"), F.translate("__shard", "+#", "-n")).alias("shard_id")) for x in (plain, dealt)]
    out[0].union(out[1]).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    scratch.drop("hot")
    return plan

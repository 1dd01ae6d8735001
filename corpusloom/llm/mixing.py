"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule draws the golden-ratio point frac(i * phi), held as i * GOLDEN mod 2^32; the point falls into one
source's interval of the cumulative weights, and the slot's rank among that source's slots names one of its blocks.
A source's documents, shuffled by a keyed hash, form one stream of words, which goes round until the target is reached.
What the mix takes of it, just the target, is cut into as many equal blocks as the source has slots (their lengths differ
by a word at most), so that no source, however small, gains or loses by whole blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
# floor(2^32 / golden ratio), odd: the Fibonacci-hashing multiplier
GOLDEN = 2654435769
SPACE = 2**32
CELL = 2**22
MOST_BROADCAST = 100_000
SLOT_CHUNK = 2**16
# of the 32 hash bits by which a source is shuffled, the leading ones that split its stream into pieces
PIECE_BITS = 12
# slots of the whole schedule where that gives a mean block within these words; slots that any source has, about
SLOTS, LEAST_BLOCK, MOST_BLOCK, LEAST_SLOTS = 2**18, 16, 4096, 64


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size in words (null text: 0), and `h`, 32 bits of a hash of the id that shuffle the documents."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long").alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """A row per source: source, weight, source_size, total, target.

    Weights go round by code point of the source, null last. A target is the source's share of all words, at most
    `most_epochs` times what it has; the rest is shared by weight again. That is one water level: in the order of
    cap / weight, the first source that its share at the level fits under ends the capped ones.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most_epochs).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ranked = (
        ranked.withColumn("pos", F.row_number().over(fill))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("heavy")
    level = F.min(F.when(fits, F.struct("pos", (F.col("left") / F.col("heavy")).alias("level")))).over(Window.partitionBy())["level"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "weight", "source_size", "total", "target")


def _intervals(goal: DataFrame) -> DataFrame:
    """`goal` with words (what the mix takes of the source: its target in whole words), n_slots of the schedule, and the
    source's interval [lo, hi) of the 2^32 points. A source's weight is its share of the target, but LEAST_SLOTS slots
    at least; sources without words have no interval.

    The windows over all sources, here and in `targets`, hold one row a source: few, whatever the corpus."""
    goal = goal.where("target >= 1").withColumn("words", F.floor("target").cast("long"))
    everything = Window.partitionBy()
    n = F.greatest(F.ceil(F.sum("words").over(everything) / block_words(F.sum("words").over(everything))), LEAST_SLOTS * F.count("*").over(everything)).cast("long")
    goal = goal.withColumn("n_slots", n).withColumn("part", F.greatest(F.col("words") / F.sum("words").over(everything), F.lit(1.0) * LEAST_SLOTS / F.col("n_slots")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lo = goal.withColumn("lo", F.floor(before / F.sum("part").over(everything) * SPACE))
    return lo.withColumn("hi", F.coalesce(F.lead("lo").over(order), F.lit(SPACE))).drop("part")


def block_words(total) -> object:
    """Words of a mean block, so that the schedule has about SLOTS slots where that gives LEAST_BLOCK to MOST_BLOCK words."""
    return F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(total / SLOTS))).cast("long")


def schedule(goal: DataFrame) -> DataFrame:
    """The mix in order: slot, source, block (the slot's rank among its source's), start and end. A block is the words
    [start, end) of the source's stream, which goes round after its last word. No words: no slots."""
    spark = goal.sparkSession
    goal = _intervals(goal)
    # one number reaches the driver: how long the schedule is
    n = goal.agg(F.max("n_slots").alias("n")).first()["n"] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(SPACE)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / CELL))
    cells = goal.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))))
    drawn = slots.join(cells, "cell").where("point >= lo and point < hi").select("slot", "source", F.col("words").alias("takes"), F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("source")
    past = F.coalesce(F.sum("n").over(by_source.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), past.alias("past"), F.sum("n").over(by_source).alias("blocks"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("block", F.col("past") + F.col("r"))
    # the first of the blocks are a word longer than the rest
    each, longer = F.expr("takes div blocks"), F.expr("takes % blocks")
    start = lambda b: b * each + F.least(b, longer)
    return ranked.select("slot", "source", "block", start(F.col("block")).alias("start"), start(F.col("block") + 1).alias("end"), "blocks", "takes")


def spans(sizes: DataFrame) -> DataFrame:
    """Each document's place [start, start + size) in its source's shuffled stream.

    A stream is summed in two steps, so that no source is one group: 2^PIECE_BITS pieces by leading hash bits, then the
    documents inside a piece."""
    pieces = sizes.withColumn("piece", F.shiftright("h", 32 - PIECE_BITS))
    inside = Window.partitionBy("source", "piece").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("source", "piece").agg(F.sum("size").alias("n"))
    past = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select(F.col("source").alias("s"), F.col("piece").alias("p"), past.alias("past"))
    placed = pieces.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("seat", F.row_number().over(Window.partitionBy("source", "piece").orderBy("h", "doc_id", "size")))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    return placed.select("doc_id", "source", "size", "piece", "seat", (F.col("past") + F.col("start")).alias("start"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words that the schedule takes of it), first_slot
    (the first slot of the mix whose block holds some of it, null if none does), n_slots (how many blocks do, each time
    round counted).

    Needs doc_id, source, text; other columns are not read. Null or empty text has size 0 and takes 0. Repeated rows are
    documents of their own; between equal ones it is open which is taken more often, the rows as a set are the same.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch(sized(docs, seed), "sizes")
    goal = scratch(targets(sizes, weights, most_epochs), "goal")
    plan = scratch(schedule(goal), "schedule")
    cut = plan.groupBy("source").agg(F.max("takes").alias("takes"), F.max("blocks").alias("blocks"))
    goal = scratch(goal.join(cut.withColumnRenamed("source", "cs"), F.col("source").eqNullSafe(F.col("cs")), "left"), "goal")
    words = goal.select(F.col("source").alias("gs"), "source_size", "target", F.coalesce("takes", F.lit(0)).alias("takes"), "blocks")
    # a row a source: handed to all tasks while they are as few as sources are, else met in a join
    words = F.broadcast(words) if goal.count() <= MOST_BROADCAST else words
    at = spans(sizes).join(words, F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    # a document's words in the stream as it goes round, as far as the target reaches
    rounds = F.sequence(F.lit(0).cast("long"), F.expr("(takes - 1 - start) div source_size"))
    at = at.withColumn("round", F.explode_outer(F.when((F.col("size") > 0) & (F.col("start") < F.col("takes")), rounds)))
    at = at.withColumn("a", F.col("start") + F.col("round") * F.col("source_size")).withColumn("z", F.least(F.col("a") + F.col("size"), F.col("takes")))
    each, longer = "(takes div blocks)", "(takes % blocks)"
    block = lambda x: F.expr(f"CASE WHEN {x} < {longer} * ({each} + 1) THEN {x} div ({each} + 1) ELSE {longer} + ({x} - {longer} * ({each} + 1)) div {each} END")
    pieces = at.withColumn("b", F.explode_outer(F.sequence(block("a"), block("(z - 1)"))))
    slots = plan.select("slot", F.col("source").alias("us"), F.col("block").alias("ub"), F.col("start").alias("us0"), F.col("end").alias("us1"))
    met = pieces.join(slots, F.col("source").eqNullSafe(F.col("us")) & (F.col("b") == F.col("ub")), "left")
    part = F.least("z", "us1") - F.greatest("a", "us0")
    return (
        met.groupBy("source", "piece", "seat", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")
    )


def repeated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` as the mix holds them: each row as often as its words are taken, to the nearest whole number. Rows that
    share a doc_id (or have none) count as one document."""
    taken = mix(docs, seed).groupBy("doc_id").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__copies"))
    taken = taken.where("`__copies` > 0").withColumnRenamed("doc_id", "__id")
    kept = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"])).drop("__id")
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")

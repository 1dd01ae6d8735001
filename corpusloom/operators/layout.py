"""Running headers and footers over the pages of books: lines that recur, the pairs of them that pages have, and a page
sequence without islands; paragraphs put together again inside texts and over page ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a page's header or footer costs against a pair that has another, none, or one where the page has none
OTHER, MISSING, ADDED = 22.0, 28.0, 10.0
# how much farther from its neighbours' pair than from its own a page may be to be taken for an island
ISLAND = 6.0
PAIR = ("book", "header", "footer")
# fixed values: ends of sentences and of lines that a hyphen cuts, and what begins a line that isn't plain text
SENTENCE_END, HYPHEN = r"[.!?]['\"”)\]]?[ \t\r\f\x0B]*$", r"-[ \t\r\f\x0B]*$"
MARKED = r"(?m)^(?:#{1,6}\s|```|\||\s{0,3}(?:[-*+]|\d+[.)])\s|\[Seite \d+\]|---+\s*$)"
BREAK, BLANKS = "\x02", " \t\r\f\x0b"


def choices(pages: DataFrame, lines: DataFrame, least: int = 2) -> DataFrame:
    """(book, page, header, top, footer, bottom) for every page of `pages` (book, page): of its `lines` (book, page, side: top or
    bottom, key, margin) whose key at least `least` pages of the book have at that side, the one with the widest margin
    (ties: the least key). Null and 0.0 where there is none."""
    recurring = lines.select("book", "side", "key", "page").distinct().groupBy("book", "side", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = lines.join(recurring, ["book", "side", "key"], "left_semi")
    best = lambda side: F.min(F.when(F.col("side") == side, F.struct((-F.col("margin")).alias("back"), "key")))
    found = held.groupBy("book", "page").agg(best("top").alias("h"), best("bottom").alias("f"))
    margin = lambda c: F.coalesce(-F.col(c)["back"], F.lit(0.0))
    return pages.distinct().join(found, ["book", "page"], "left").select("book", "page", F.col("h.key").alias("header"), margin("h").alias("top"), F.col("f.key").alias("footer"), margin("f").alias("bottom"))


def quantiles(rows: DataFrame, by: tuple, value: str, at: dict[str, float]) -> DataFrame:
    """(*by, n, a column for each name of `at`): a group's rows, and the value at place round(q * (n - 1)) of a group's sorted values, halves to even. Equal
    values are counted first, so that only a group's distinct ones are sorted."""
    order = Window.partitionBy(*by).orderBy(value)
    runs = rows.groupBy(*by, value).agg(F.count("*").alias("__c"))
    runs = runs.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    return runs.groupBy(*by).agg(F.max("__n").alias("n"), *(F.min(F.when(F.col("__upto") > F.bround(F.lit(q) * (F.col("__n") - 1)), F.col(value))).alias(name) for name, q in at.items()))


def pairs(chosen: DataFrame, most: int = 3) -> DataFrame:
    """(book, header, footer, n, place, selected, proto_top, proto_bottom) of each pair that pages of a book have: pages, rank (more
    pages, then more sides, then wider margins in the middle), whether it is one of the `most` that stand for the book, and its
    margins at 85 of 100. A book's empty pair gives way to the best other one where it would come first."""
    margins = chosen.select(*PAIR, F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("margin")) for c in ("top", "bottom")))).alias("m")).select(*PAIR, "m.*")
    found = quantiles(margins, (*PAIR, "side"), "margin", {"mid": 0.5, "proto": 0.85})
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("proto"))).alias(f"proto_{side}")
    met = found.groupBy(*PAIR).agg(F.max("n").alias("n"), F.sum("mid").alias("mid"), of("top"), of("bottom"))
    sides = F.col("header").isNotNull().cast("int") + F.col("footer").isNotNull().cast("int")
    order = Window.partitionBy("book").orderBy(F.desc("n"), sides.desc(), F.desc("mid"), F.asc_nulls_first("header"), F.asc_nulls_first("footer"))
    ranked = met.withColumn("place", F.row_number().over(order)).withColumn("sides", sides)
    book = Window.partitionBy("book")
    yields = F.max((F.col("place") == 1) & (F.col("sides") == 0)).over(book) & (F.max("place").over(book) > 1)
    selected = F.when(yields, (F.col("place") > 1) & (F.col("place") <= max(most, 2))).otherwise(F.col("place") <= most)
    return ranked.select(*PAIR, "n", "place", selected.alias("selected"), "proto_top", "proto_bottom")


def _side(own: str, proto: str) -> Column:
    a, b = F.col(own), F.col(proto)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a != b, OTHER).otherwise(0.0)).when(a.isNotNull(), MISSING).when(b.isNotNull(), ADDED).otherwise(0.0)


def assigned(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """(book, page, place): the selected pair that a page is nearest to, by margins and by what differs; ties: the better rank. A
    book has few selected pairs, so a page meets few."""
    protos = found.where("selected").select("book", "place", F.col("header").alias("h"), F.col("footer").alias("f"), "proto_top", "proto_bottom")
    distance = F.abs(F.col("top") - F.col("proto_top")) + F.abs(F.col("bottom") - F.col("proto_bottom")) + _side("header", "h") + _side("footer", "f")
    met = chosen.join(protos, "book").select("book", "page", "place", distance.alias("distance"))
    all_ = F.map_from_entries(F.collect_list(F.struct("place", "distance")))
    return met.groupBy("book", "page").agg(F.min(F.struct("distance", "place"))["place"].alias("place"), all_.alias("distances"))


def smoothed(pages: DataFrame) -> DataFrame:
    """(book, page, place, smooth) of `assigned` pages: a page between two pages of one other pair takes theirs, if that is at most ISLAND
    farther, unless the page before has just changed. So in a row of pages that could change each second one does: rows
    are told apart by the difference of two numberings."""
    order = Window.partitionBy("book").orderBy("page")
    before, after = F.lag("place").over(order), F.lead("place").over(order)
    near = F.col("distances")[F.col("before")] <= F.col("distances")[F.col("place")] + ISLAND
    rows = pages.withColumn("before", before).withColumn("after", after).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("could", F.coalesce((F.col("before") == F.col("after")) & (F.col("place") != F.col("before")) & near, F.lit(False)))
    rows = rows.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("book", "could").orderBy("page")))
    nth = F.row_number().over(Window.partitionBy("book", "could", "run").orderBy("page"))
    return rows.withColumn("nth", nth).select("book", "page", "place", F.when(F.col("could") & (F.col("nth") % 2 == 1), F.col("before")).otherwise(F.col("place")).alias("smooth"))


def reflowed(df: DataFrame, key: str, text: str = "text", fill: float = 0.75) -> DataFrame:
    """(key, nth, paragraph) of each text: lines put together until a blank line, or until a sentence ends in a line that is shorter than `fill`
    of the width that 85 of 100 lines stay under; a hyphen at a line's end goes, and the next line is joined without a space. A row's lines
    are looked at in pairs of neighbours, so a text of any length takes one pass and no shuffle; null texts have no paragraphs."""
    lines = df.select(key, F.transform(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(BLANKS))).alias("l"))
    sizes = F.array_sort(F.transform(F.filter("l", lambda x: x != ""), lambda x: F.length(F.btrim(x, F.lit(BLANKS)))))
    lines = lines.withColumn("sizes", sizes).select(key, "l", F.greatest(F.lit(1), F.coalesce(F.get("sizes", F.floor((F.size("sizes") - 1) * 0.85).cast("int")), F.lit(1))).alias("width"))

    def piece(line: Column, before: Column, width: Column) -> Column:
        cut = before.rlike(HYPHEN)
        ends = before.rlike(SENTENCE_END) & (F.length(F.btrim(before, F.lit(BLANKS))) < width * fill)
        gap = F.when(F.coalesce(before, F.lit("")) == "", F.lit("")).when(cut, F.lit("")).when(ends, F.lit(BREAK)).otherwise(F.lit(" "))
        own = F.when(line.rlike(HYPHEN), F.rtrim(F.rtrim(line, F.lit("-")), F.lit(BLANKS))).otherwise(line)
        return F.when(line == "", F.lit(BREAK)).otherwise(F.concat(gap, own))

    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice("l", 1, F.size("l") - 1))
    whole = F.array_join(F.zip_with("l", shifted, lambda x, y: piece(x, y, F.col("width"))), "")
    parts = lines.select(key, F.posexplode(F.filter(F.split(whole, BREAK), lambda p: p != "")).alias("nth", "paragraph"))
    return parts.select(key, (F.col("nth") + 1).cast("long").alias("nth"), "paragraph")


def merged_pages(pages: DataFrame) -> DataFrame:
    """(book, page, text) of `pages` with paragraphs that go over a page's end put together on the page where they begin: the last block of a
    page and the first of the next, where both are plain text and the first doesn't end a sentence, or the second begins with
    a small letter. A page that gives away its only block has none to go on, so in a row of pages with one block each second
    one gives."""
    order = Window.partitionBy("book").orderBy("page")
    cut = pages.select("book", "page", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n[\s]*"), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "").alias("b"))
    rows = cut.select("book", "page", "b", F.size("b").alias("n"), F.get("b", F.lit(0)).alias("first"), F.get("b", F.size("b") - 1).alias("last"))
    rows = rows.withColumn("tail", F.lag("last").over(order)).withColumn("left", F.lag("n").over(order))
    plain = ~F.col("tail").rlike(MARKED) & ~F.col("first").rlike(MARKED)
    could = plain & (~F.col("tail").rlike(SENTENCE_END) | F.col("first").rlike(r"^\p{Ll}"))
    rows = rows.withColumn("could", F.coalesce(could, F.lit(False)))
    chained = F.col("could") & (F.col("left") == 1) & F.coalesce(F.lag("could").over(order), F.lit(False))
    rows = rows.withColumn("chain", F.sum((~chained).cast("int")).over(order))
    nth = F.row_number().over(Window.partitionBy("book", "chain").orderBy("page"))
    rows = rows.withColumn("gives", F.col("could") & (nth % 2 == 1))
    rows = rows.withColumn("takes", F.when(F.lead("gives").over(order), F.lead("first").over(order)))
    joined = F.when(F.col("last").rlike(HYPHEN), F.concat(F.rtrim(F.rtrim(F.rtrim("last"), F.lit("-"))), F.col("takes"))).otherwise(F.concat_ws(" ", "last", "takes"))
    kept = F.when(F.col("takes").isNotNull(), F.concat(F.slice("b", 1, F.greatest(F.col("n") - 1, F.lit(0))), F.array(joined))).otherwise(F.col("b"))
    kept = F.when(F.col("gives"), F.slice(kept, 2, F.greatest(F.col("n") - 1, F.lit(0)))).otherwise(kept)
    return rows.select("book", "page", F.array_join(kept, "\n\n").alias("text"))

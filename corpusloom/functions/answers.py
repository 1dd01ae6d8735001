"""What a model's answers say: JSON inside prose, facts, verdicts and the winner of a comparison, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_cell, unescaped

# fixed values: the keys under which an answer may name a thing, in the order in which they are tried
WINNER_KEYS = ("winner", "choice", "selected", "pick")
CONFIDENCE_KEYS = ("confidence", "score", "probability", "certainty")
LIST_KEYS = ("facts", "claims", "items", "data", "sentences")
FACT_KEYS = ("fact", "claim", "text", "sentence")
# fixed values: how prose names a winner
WINNER_PROSE = (
    r"\b(?:winner|choice|auswahl|entscheidung|selected|pick)\s*[:=-]?\s*([AB])\b",
    r"\b(?:antwort|answer|option|kandidat|candidate)\s*([AB])\s*(?:ist|is|wins|gewinnt|better|besser)\b",
    r"\b([AB])\s*(?:ist|is)\s*(?:besser|better)\b",
)


def json_payload(text: Column) -> Column:
    """The JSON that a text is, or that its first fence, or else its outermost brackets or braces hold, as a variant; null
    without any."""
    plain = F.btrim(unescaped(text), F.lit(" \t\r\n"))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(plain.rlike(fence), F.btrim(F.regexp_extract(plain, fence, 1), F.lit(" \t\r\n"))).otherwise(plain)
    # what is not found is an empty string, which is no JSON
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\[.*\]", 0)), F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))


def _said(value: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value under one of some keys, as a string."""
    each = [F.try_variant_get(value, f"$.{k}", "string") for k in keys]
    return F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in each))


def facts(payload: Column) -> Column:
    """The strings of a list, and of its objects the first that stands under a key for facts; of an object the first such
    list that has any."""
    def strings(path):
        of = F.coalesce(F.try_variant_get(payload, path, "array<variant>"), F.array().cast("array<variant>"))
        text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_said(v, FACT_KEYS))
        return F.filter(F.transform(of, text), lambda x: x.isNotNull())

    lists = [strings("$"), *(strings(f"$.{k}") for k in LIST_KEYS)]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<string>"))


def confidence(value: Column) -> Column:
    """A number as a share: over 1, up to 100, it is a percentage; null if it is no number."""
    x = value.try_cast("double")
    return F.when(x > 1, F.when(x <= 100, x / 100).otherwise(1.0)).otherwise(F.when(x < 0, 0.0).otherwise(x))


def winner(said: Column) -> Column:
    """A or B for the spellings of a winner, else null."""
    low = F.lower(F.trim(said))
    for side, others in (("a", ("left", "1")), ("b", ("right", "2"))):
        names = [side, *(f"{n}{gap}{side}" for n in ("answer", "option", "candidate") for gap in ("_", " ")), *others]
        low = F.when(low.isin(*names), side.upper()).otherwise(low)
    return F.when(low.isin("A", "B"), low)


def judged(text: Column) -> Column:
    """(winner, confidence, mode) of a judge's answer: from its first JSON object, else from its words, else unparsed."""
    # up to the first closing brace, or to the last one where objects are nested
    value = F.coalesce(*(F.try_parse_json(F.regexp_extract(text, r, 0)) for r in (r"(?s)\{.*?\}", r"(?s)\{.*\}")))
    told = winner(_said(value, WINNER_KEYS))
    upper = F.upper(F.btrim(text, F.lit(" \t\r\n")))
    prose = F.coalesce(F.when(upper.isin("A", "B"), upper), *(F.nullif(F.regexp_extract(upper, "(?i)" + p, 1), F.lit("")) for p in WINNER_PROSE))
    mode = F.when(told.isNotNull(), "json").when(prose.isNotNull(), "regex").otherwise("unparsed")
    sure = F.when(told.isNotNull(), confidence(_said(value, CONFIDENCE_KEYS)))
    return F.struct(F.coalesce(told, prose, F.lit("")).alias("winner"), sure.alias("confidence"), mode.alias("mode"))


def fragment(text: Column) -> Column:
    """Whether a text is no fact: marks only, a placeholder, a word or two, or an introduction."""
    x = clean_cell(text)
    low = F.lower(x)
    n = F.regexp_count(x, F.lit(r"\p{L}{2,}"))
    marks = x.rlike(r"^[-–—_=~*#.`:;/\\|+\s]+$") | low.rlike(r"^(?:col|column|item)\s*\d+$")
    short = (n <= 1) & (F.length(x) <= 24) | (n < 2) & (F.length(x) < 10)
    return F.coalesce((x == "") | marks | low.isin("beispiele:", "example:", "happy writing.", "view.", "context.") | short | x.endswith(":"), F.lit(True))


def pattern_normal(text: Column) -> Column:
    """A search pattern without its name, list mark and the quotes round it; null if nothing or over 240 characters stay."""
    x = F.btrim(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"(?i)^\s*regex\s*:\s*", ""))
    x = F.btrim(F.regexp_replace(x, r"^\s*(?:[-*•]+|\d+[.)])\s*", ""))
    quoted = (F.length(x) >= 2) & (F.substring(x, 1, 1) == F.substring(x, -1, 1)) & F.substring(x, 1, 1).isin("\"", "'", "`")
    x = F.when(quoted, F.btrim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)
    return F.when((x != "") & (F.length(x) <= 240), x)

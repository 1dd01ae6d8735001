"""The corpus pipeline: language, quality, near duplicates, source mix, tokens.

Each stage reads what the one before it kept, as Parquet in the shared folder, and decides for every row of it. Rows keep
the columns of documents, whatever they are, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language, minhash, mixing, quality
from corpusloom.llm.queries import vocabulary
from corpusloom.session import spread, staged, table

# SQL has no expression for mixture inference or suffix arrays; tests hold the stages against brute force
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """Each row whole, beside its text: columns of any name pass through a stage."""
    return docs.select(F.struct("*").alias("__row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose letters the best mixture of the learned languages explains no better
    than characters drawn at random: they are in none of these languages. Texts in several languages stay. Where no document
    has a label there is no model, and nothing goes."""
    model = language.fit(docs)
    if model is None:
        return docs
    told = language.identify(_packed(docs), model, keep=("__row",))
    return told.where("fits").select("__row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: too few words, too many repeated ones, or too long a repeat. Null texts
    have no words."""
    return quality.judged(quality.measured(_packed(docs), keep=("__row",))).where("kept").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id. The ids that go are the short side of the join. Rows
    that share an id and a text are one document; rows without an id stay."""
    found = staged(minhash.near_duplicates(docs), "pipeline-near")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    kept = docs.join(ids.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = staged(ids.where("kept and n > 1").select("doc_id"), "pipeline-again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number; rows that it doesn't take go."""
    return mixing.repeated(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    coded = bpe.round_trip(docs, vocabulary(), keep=("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language", identify_language), ("quality", apply_quality_rules), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("tokens", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents, each on what the one before it kept."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = spread(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)

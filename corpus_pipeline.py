"""Corpus pipeline: stages over documents, each of which may be written as Parquet and read again by the next.

Every stage works row by row as far as ids go: rows of a null or a repeated doc_id are documents of their own. Null and
empty texts have no letters, so the first stage drops them; each later stage would keep them. Empty tables give empty
tables. Columns of any name pass through all stages but the last as they are.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.llm import decontaminate, jaccard, language, linelog, pieces
from querysieve.llm.common import unused
from querysieve.llm.queries import model_file, table
from querysieve.session import ship


def stage(f):
    """A stage whose session has this package on its workers."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(ship(spark), docs, sf_dir)

    return run_stage


#: Words of a hit that is enough by itself. Hits are windows of decontaminate.SPAN words or whole shorter items, so only
#: whole items of fewer words than this, which any text may hold, need a second item.
LEAST_HIT = decontaminate.K

#: A text this far from every learned language, or without letters, is rejected.
LEAST_SCORE = 0.2


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in one of the languages that the labelled ones teach."""
    lang, score = unused(docs, "lang_pred", "score")
    found = language.predict(docs, language.learn(docs), lang_pred=lang, score=score)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; one that consists of such lines goes.

    Long lines that copies share stay: without them what is left of a copy is no near-duplicate any more.
    """
    lines, dropped = unused(docs, "n_lines", "n_dropped")
    cleaned = linelog.clean(docs, short=True, counts=(lines, dropped)).where((F.col(dropped) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that near-duplicate links hold together; a null id comes last.

    A row is known by its id and text: equal ids with other texts are other documents, and of rows equal in both one stays.
    """
    (row,) = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    groups = jaccard.groups(keyed, row).where("n_shingles > 0").select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    ids = keyed.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("i")).join(groups.distinct(), "r").distinct()
    stays = ids.groupBy("c").agg(F.min(F.struct(F.col("i").isNull(), "i", "r")).alias("least")).select("least.r")
    goes = ids.select("r").join(stays, "r", "left_anti").select(F.col("r").alias(row)).distinct()
    return keyed.join(goes, row, "left_anti").dropDuplicates([row]).select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items: one of two items, or one run of LEAST_HIT words or more, takes a document out."""
    added = unused(docs, "n_words", "hits", "items")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), added=tuple(added))
    long = F.exists(added[1], lambda h: h["end"] - h["start"] >= LEAST_HIT)
    return found.where((F.size(added[2]) < 2) & ~long).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' token ids and of what they decode to."""
    return pieces.digests(docs, model_file())


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]
#: Templates, profiles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""Corpus pipeline: quality, near-duplicates, secrets, source mix, tokens.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns what goes on. Between stages the table is written as Parquet to the shared folder
and read again. SQL cannot express the fitted classifier, the linked secrets or the
merges; tests hold each stage, and ``run`` as a whole, against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import bpe, mixing, neardup, quality, secret_links
from traceloom.llm.common import discard, materialize, read
from traceloom.scratch import scope

#: Row keys to drop that may be broadcast (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    model = quality.fitted(spark, docs, sf_dir)
    scored = quality.score(docs, model, keep=tuple(docs.columns))
    return scored.where("kept").select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five words of a shingle, similarity 0.8): of the smallest id, if any has one.

    Rows are judged one by one, by a key of their own: ids may be null, or repeat with
    the same or other texts. Rows without words are near no other and stay.
    """
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    ids = keyed.select("doc_id", "_row")
    found = materialize(neardup.near_duplicates(keyed, id_col="_row", shingle=5), "found")
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_c")).join(ids, "_row")
    # one row a group by partial aggregates; what goes is told by rows, so that a large group is never dealt out as one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stay = groups.groupBy("_c").agg(first["_row"].alias("_row")).select("_row")
    gone = materialize(groups.select("_row").join(stay, "_row", "left_anti"), "gone")
    discard(found)
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_row", "left_anti")
    return left.select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts of credentials are replaced by markers; all documents go on."""
    out = secret_links.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return bpe.digest(docs, with_ids=True)


STAGES = [("quality", good), ("near_duplicates", unique), ("secrets", redacted), ("mix", mixed), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of the stages before are removed when the next stage has been written."""
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope() as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)

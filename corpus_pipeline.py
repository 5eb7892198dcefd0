"""From raw documents to token ids: five stages, each one a corpus operator.

Every stage but the last returns the columns of its input. ``run`` writes each stage's result
to the shared folder and reads it again, so that a lost executor repeats one stage's tasks at
most. Rows without an id go through all stages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import bpe, decontaminate, near_dup, quality_rules
from tillspark.llm.common import WORD, table, written
from tillspark.llm.line_dedup import dedup_lines
from tillspark.llm.queries import vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines."""
    crf = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, crf, prefix="_ll_").where("_ll_kept").select(*docs.columns)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site lines; a document of nothing else goes."""
    out = dedup_lines(docs, added=("_ll_lines", "_ll_removed")).where((F.col("_ll_removed") == 0) | F.col("text").rlike(WORD))
    n_chars = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, rows without one last, then the smallest key.

    Rows are known by a hash of id and text, so ids may be null or repeated. Of rows alike in id
    and text one stays, the first in the order of all their columns.
    """
    key = F.xxhash64("doc_id", F.lit("/"), "text")
    found = near_dup.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    groups = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_ll_key")).agg(F.min("component_id").alias("component"))
    ids = docs.select(key.alias("_ll_key"), "doc_id").groupBy("_ll_key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"))
    rows = written(ids.join(groups.hint("merge"), "_ll_key", "left"), "near-rows")
    inside = rows.where("component is not null")
    stays = inside.groupBy("component").agg(F.min_by("_ll_key", F.struct(F.col("doc").isNull(), "doc", "_ll_key")).alias("stays"))
    # Later copies grow with the corpus: a merge join at every size, never a broadcast of them.
    later = inside.join(written(stays, "near-stays").hint("merge"), "component").where("_ll_key <> stays").select(F.col("_ll_key").alias("_ll_later"))
    kept = docs.join(written(later, "near-later").hint("merge"), key == F.col("_ll_later"), "left_anti")
    again = rows.where("n > 1").select(F.col("_ll_key").alias("_ll_again"))
    if not again.head(1):
        return kept
    same = written(kept.join(again.hint("merge"), key == F.col("_ll_again"), "left_semi"), "near-same")
    row = F.struct(*docs.columns)
    one = same.groupBy(F.col("doc_id").alias("_ll_id"), F.col("text").alias("_ll_text")).agg(F.min_by(row, F.to_json(row)).alias("_ll_row")).select("_ll_row.*")
    return kept.join(again.hint("merge"), key == F.col("_ll_again"), "left_anti").unionByName(one)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every text that is left."""
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary_path())
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", cut_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode_tokens),
]

#: A learned labeller, a randomised join and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
